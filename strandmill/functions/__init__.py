"""Column functions over bases, header fields, bit strings and quality characters."""
