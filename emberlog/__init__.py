"""Log analytics on Spark: parse, mine, clean, score, label and serve log lines."""

__version__ = "0.1.0"
