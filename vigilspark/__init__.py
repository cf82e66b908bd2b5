"""A PySpark-native analytics engine for web-server compromise triage."""
