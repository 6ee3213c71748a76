"""A SPARQL subset compiled to DataFrames."""
