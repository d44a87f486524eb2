"""Evidence analytics over event logs, on Spark."""
