"""Graph analytics on Spark: quads as DataFrames, SPARQL compiled to Catalyst plans."""
