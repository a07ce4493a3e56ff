"""Independent SQL for checking the Spark queries."""
