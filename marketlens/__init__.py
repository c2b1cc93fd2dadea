"""Market-intelligence and corpus operators as Spark DataFrame functions."""
