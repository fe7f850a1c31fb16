"""Column functions: parsing, rounding, scales and the rating formulas."""
