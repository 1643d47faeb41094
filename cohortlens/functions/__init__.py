"""Column expressions: label vocabularies, numbers, text, bands."""
