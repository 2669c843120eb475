"""A PySpark-native engine for curating preference data across many clients."""
