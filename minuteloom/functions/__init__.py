"""Column builders; the few Arrow UDFs are in functions.udf."""
