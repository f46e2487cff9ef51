"""Analytics over tall raster strips, and the tables derived from them, on Spark."""
