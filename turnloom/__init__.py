"""turnloom: Spark-native analytics over conversational memory."""
