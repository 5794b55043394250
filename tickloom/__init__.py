"""Market-tape analytics on Spark: DataFrame-first operators over order-book and trade events."""
