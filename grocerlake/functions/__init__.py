"""Column functions: text, barcodes, scoring, label fields."""
