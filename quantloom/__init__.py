"""quantloom: a Spark-native market-microstructure factor engine."""
