"""Scalar functions that Spark lacks: tail probabilities of the usual distributions."""
