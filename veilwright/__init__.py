"""Statistical disclosure control on Spark."""
