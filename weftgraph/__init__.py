"""A Spark-native engine for typed, provenance-tagged property graphs and the tables around them."""
