"""All-pairs similarity search over short sequences, on Spark."""
