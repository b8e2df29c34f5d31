"""Scalar rules of the fact layer, as Column expressions."""
