"""Column functions and encodings."""
