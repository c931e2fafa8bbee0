"""PySpark-native analytics for event-contract markets."""
