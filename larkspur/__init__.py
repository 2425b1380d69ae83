"""larkspur: product-review analytics as ordinary Spark DataFrame jobs."""
