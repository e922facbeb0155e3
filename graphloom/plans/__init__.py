"""Query plans: a SPARQL subset, its algebra, and their lowering to DataFrames."""
