"""lexmill: document retrieval, review and training-data analytics as PySpark plans."""
