"""marquee: a PySpark-native analytics engine for an event catalogue."""
