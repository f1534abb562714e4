"""Knowledge-graph retrieval analytics on Spark."""
