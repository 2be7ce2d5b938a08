"""millrace: evidence analytics for large text corpora, written for PySpark."""
