"""webloom: a Spark-native analytics engine for web corpora."""
