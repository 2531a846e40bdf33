"""Knowledge-graph building and querying as Spark DataFrame operations."""
