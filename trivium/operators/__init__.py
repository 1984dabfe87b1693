"""Relational operators on DataFrames that carry certainty."""
