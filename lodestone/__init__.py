"""Lodestone: benchmark analytics and raster-graph kernels on PySpark DataFrames."""
