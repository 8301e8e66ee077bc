"""Column expressions: text, classification, labels, quality and addresses."""
