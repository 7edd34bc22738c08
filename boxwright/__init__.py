"""boxwright: a PySpark-native engine for curating, filtering and evaluating detection data."""
