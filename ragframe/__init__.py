"""PySpark-native engine for building, searching and evaluating document collections."""
