"""millrace: retrieval-pipeline diagnosis and text-corpus processing on Spark."""
