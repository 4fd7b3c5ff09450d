"""Spark-native geospatial tile, raster and terrain analytics."""
