"""Operators on detections, label sequences and boxes: DataFrames in, DataFrames out."""
