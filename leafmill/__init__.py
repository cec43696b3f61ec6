"""leafmill: web-page facts and corpus processing as PySpark plans."""

__version__ = "0.1.0"
