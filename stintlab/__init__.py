"""Analytics of vehicle recordings as DataFrame-to-DataFrame operators on PySpark."""
