"""A Spark-native engine for versioned property graphs, text retrieval and the tables around them."""
