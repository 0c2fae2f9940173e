"""A PySpark engine for document analytics."""
