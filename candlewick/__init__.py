"""candlewick: market-data and news analytics written as Spark DataFrame operators."""
