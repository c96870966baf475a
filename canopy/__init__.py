"""canopy: Bayesian sum-of-trees analytics on Spark DataFrames."""
