"""Operators on DataFrames: alignment, schemas, rechunking, combination, references."""
