"""PySpark-native analytics over recognised documents."""
