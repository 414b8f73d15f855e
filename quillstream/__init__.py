"""Spark-native operators for curating, ranking and auditing timestamped documents."""
