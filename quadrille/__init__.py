"""quadrille: raster-window analytics on Spark DataFrames of integer pixel cells."""

__version__ = "0.1.0"
