"""marginalia: a PySpark-native engine for building and querying text knowledge bases."""
