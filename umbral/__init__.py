"""Volume-hiding relational analytics on Spark; see README.md."""
