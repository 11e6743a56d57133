"""Rules over log and event data, evaluated on a tick grid with Spark."""
