"""The analyses, each a function from DataFrames to a DataFrame."""
