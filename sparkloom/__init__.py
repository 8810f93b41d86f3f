"""A Spark-native engine for data-stack discovery, SQL algebra and workload analytics."""
