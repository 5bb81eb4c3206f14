"""Column functions: text, text quality and tensor arithmetic."""
