"""Analytics of two-party interaction logs as Spark DataFrame operators."""
