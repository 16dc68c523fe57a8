"""Web-graph queries and training-data operators on PySpark."""
