"""Column expressions: tokens, n-grams, list strings, mentions and common substrings."""
