"""Column expressions: parsing, units, text cleaning and labels."""
