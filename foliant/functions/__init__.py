"""Column -> Column text, structure and quality functions."""
