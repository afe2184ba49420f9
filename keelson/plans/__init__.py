"""Plans as plain values: nodes, their checks and texts, and compilation to DataFrames."""
