"""chronoweave: set-at-a-time analytics for bitemporal knowledge graphs on Spark."""

__all__ = ["__version__"]

__version__ = "0.1.0"
