"""Column functions: geometry, text, JSON, headings."""
