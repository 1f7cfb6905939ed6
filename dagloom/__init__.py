"""A PySpark-native engine for analysing and running directed acyclic graphs of work."""
