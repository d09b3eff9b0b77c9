"""Map-extract analytics on Spark: staging, assembly, tagging, places, roads, tiles and style as DataFrame jobs."""
