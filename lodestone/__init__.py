"""Code and text retrieval analytics on Spark."""
