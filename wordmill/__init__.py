"""wordmill: text analysis and search preparation as Spark column expressions."""

__version__ = "0.1.0"
