"""CSV in and out, report tables, stored models."""
