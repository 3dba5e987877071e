"""kvtrail: configuration-history and secret-scanning analytics on PySpark."""
