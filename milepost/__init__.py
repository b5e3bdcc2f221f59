"""Milepost: Spark-native analytics over monthly panels of long-running projects."""
