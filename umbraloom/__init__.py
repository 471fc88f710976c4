"""Shadow-height raster analytics and corpus preparation on Spark."""
