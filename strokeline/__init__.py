"""Spark-native analytics over hand-drawn technical drawings held as tables."""
