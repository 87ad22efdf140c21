"""Spark-native engine for hand-object contact analytics over per-frame detections."""
