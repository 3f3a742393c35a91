"""Labelled N-dimensional arrays on Spark: patterns, schemas, chunk grids, rechunking, stores."""
