"""keystrata: versioned key-value change logs on Spark, in log-structured layers."""
