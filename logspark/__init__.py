"""Log analytics on Spark: text logs in, one typed table of entries out, and the operations on that table."""
