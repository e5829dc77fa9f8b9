"""Operators for preparing training data: duplicates, survivors, packing, mixing and residue."""
