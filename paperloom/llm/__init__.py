"""Operators for large training corpora. Nothing else in paperloom imports this subpackage."""
