"""Table-aware retrieval and question answering over mixed text and tables, on Spark."""

__version__ = "0.1.0"
