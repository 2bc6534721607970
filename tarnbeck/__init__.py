"""tarnbeck: a PySpark-native analytics engine built from pure DataFrame transformations."""
