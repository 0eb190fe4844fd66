"""Transformations: DataFrame in, DataFrame out."""
