"""Plan-driven analytics on Spark: compile small validated query plans to DataFrame operations."""
