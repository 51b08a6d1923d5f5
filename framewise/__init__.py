"""Perception-data operators on Spark DataFrames.

Detections, skeletons, point clouds, sensor streams, numeric tensors and
evaluation text are plain DataFrames here; every operator is a function from
DataFrame (or Column) to DataFrame (or Column).
"""
