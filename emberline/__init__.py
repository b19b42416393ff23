"""Space-time event analytics and corpus preparation as PySpark DataFrame operators."""
