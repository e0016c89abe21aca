"""tidemark: Spark-native analytics for keyed time series and text."""
