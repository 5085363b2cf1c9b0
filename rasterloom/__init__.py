"""Forward-mapped raster analytics on PySpark: frames, lattices and fragments as DataFrames."""
