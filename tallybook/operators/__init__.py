"""Portfolio analyses: each takes DataFrames and returns a lazy DataFrame."""
