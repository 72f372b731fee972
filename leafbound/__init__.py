"""leafbound: page-stream segmentation and corpus preparation on Spark DataFrames."""
