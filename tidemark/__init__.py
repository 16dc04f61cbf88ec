"""Time-series networks, states and regimes as Spark DataFrame operations."""
