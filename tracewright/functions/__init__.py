"""Column-level building blocks: redaction, identifiers, words."""
