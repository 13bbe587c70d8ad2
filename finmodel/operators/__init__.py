"""Operators on DataFrames of entities, scenarios and series."""
