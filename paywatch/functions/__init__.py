"""Pure column expressions: scoring, normalisation, text and hashing."""
