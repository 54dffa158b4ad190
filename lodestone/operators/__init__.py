"""Relational, raster, graph and spatial operators over DataFrames."""
