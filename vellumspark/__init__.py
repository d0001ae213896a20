"""A PySpark-native engine for evidence-grounded document collections."""
