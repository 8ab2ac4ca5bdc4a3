"""Market and economic time-series analytics as Spark DataFrame operators."""
