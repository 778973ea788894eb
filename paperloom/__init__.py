"""Long-document analytics on Spark."""
