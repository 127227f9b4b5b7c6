"""A multi-model analytics engine on PySpark: measurements, tables, documents, vectors and full text."""
