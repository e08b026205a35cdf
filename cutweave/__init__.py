"""Graph perturbation jobs on Spark: DataFrame in, DataFrame out."""
