"""A Spark-native engine for producing and curating language-model training data."""
