"""runweave: Spark-native analytics over families of time-series runs."""
