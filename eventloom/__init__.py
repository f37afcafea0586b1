"""A PySpark-native engine for events, intervals and corpora."""
