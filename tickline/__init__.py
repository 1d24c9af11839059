"""A PySpark analytics engine for market odds and tickets."""
