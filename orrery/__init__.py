"""Analytics engine for typed objects on PySpark."""
