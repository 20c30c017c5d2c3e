"""A PySpark engine for graphs of source code and for relational data shaped like them."""
