"""End-to-end steps; each takes and returns DataFrames."""
