"""Scalar functions: JSON, templates, identifiers, times and type-aware extraction."""
