"""A PySpark engine for tagged raster-image data."""
