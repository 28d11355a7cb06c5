"""Detection-dataset analytics on Spark DataFrames: boxes, tiles, labels, scored detections, pixels and experiment tables."""
