"""Column helpers shared by every operator (built-in Spark expressions only)."""
