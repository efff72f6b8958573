"""A Spark-native engine for long-lived conversation memory."""
