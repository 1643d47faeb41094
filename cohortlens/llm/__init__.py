"""Operators for training data: duplicates, leaks, toxicity, secrets, personal data, URL rules, vectors, mixing."""
