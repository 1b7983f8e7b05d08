"""A PySpark-native SQL, vector and text analytics engine."""
