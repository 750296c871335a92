"""Time-series panel analytics, declared as Spark DataFrame plans."""
