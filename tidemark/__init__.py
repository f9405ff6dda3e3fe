"""tidemark: Spark-native recommendation analytics and corpus preparation."""
