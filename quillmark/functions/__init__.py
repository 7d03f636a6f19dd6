"""Scalar functions: text, similarity and images."""
