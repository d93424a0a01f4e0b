"""twinweave: clone detection and duplication analytics as PySpark plans."""

__version__ = "0.1.0"
