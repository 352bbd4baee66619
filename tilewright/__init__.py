"""Tile, elevation and build-log analytics as ordinary Spark DataFrames."""
