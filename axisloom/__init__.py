"""Segmentation of an ordered axis by the behaviour of many tracks along it, as Spark jobs over DataFrames."""
