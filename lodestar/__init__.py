"""A PySpark-native analytics engine: plans over DataFrames, checked against an SQL oracle."""
