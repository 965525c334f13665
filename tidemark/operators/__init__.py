"""Operators over DataFrames: intervals, synchronisation, differences, registry, acquisition, profiles."""
