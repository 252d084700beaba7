"""tickerloom: market-data analytics operators as plain PySpark DataFrame functions."""
