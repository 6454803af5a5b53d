"""Entity-by-day panel analytics expressed as PySpark DataFrame queries."""
