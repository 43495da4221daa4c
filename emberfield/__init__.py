"""emberfield: Spark-native analytics over satellite thermal-anomaly detections."""
