"""A PySpark engine that proves ledgers row by row, and prepares training data at scale."""
