"""noticelake: a PySpark-native analytics engine for verifiable public notices."""
