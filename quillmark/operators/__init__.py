"""Operators over documents: verbatim, semantic, figure and layout layers."""
