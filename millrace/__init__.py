"""A Spark-native engine for tabular preparation and classical machine learning."""
