"""Case-link analytics on Spark: table-in, table-out operators over all cases at once."""
