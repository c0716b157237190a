"""pairlab: data work around supervised text pairs on PySpark."""
