"""A PySpark-native federated analytics engine."""
