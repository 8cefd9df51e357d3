"""Transit analytics and corpus preparation on Spark."""
