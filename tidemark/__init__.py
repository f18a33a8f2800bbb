"""Tidemark: versioned mutation logs, replicated-log analytics and benchmark analytics on Spark."""

__version__ = "0.1.0"
