"""ledgerloom: a Spark-native analytics engine for file catalogs."""
