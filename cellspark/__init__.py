"""PySpark-native analytics for object-level image and spatial-statistics workloads."""
