"""Scalar functions: text, quantities, dates and similarity."""
