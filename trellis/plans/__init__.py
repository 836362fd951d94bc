"""The catalogue of queries over the driver's tables, and SQL for the same results."""
