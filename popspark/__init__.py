"""PySpark-native population-genetics simulation and analytics."""
