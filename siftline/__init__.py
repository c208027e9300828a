"""A PySpark engine for duplicate-content detection over file catalogs."""
