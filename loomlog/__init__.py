"""Product-log analytics as plain PySpark DataFrame functions."""
