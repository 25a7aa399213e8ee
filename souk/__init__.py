"""A Spark-native analytics engine for an online marketplace."""
