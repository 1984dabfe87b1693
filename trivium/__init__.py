"""Three-valued fact analytics on Spark."""
