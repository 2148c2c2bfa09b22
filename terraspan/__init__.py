"""terraspan: geospatial, raster, tile and keyframe analytics on PySpark DataFrames."""
