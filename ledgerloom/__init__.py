"""A Spark-native data engine for equity and investment research."""
