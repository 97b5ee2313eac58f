"""A Spark-native relational engine: a small SQL dialect, an operator layer, versioned tables and clients."""
