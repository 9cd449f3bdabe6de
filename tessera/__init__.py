"""Region-of-interest-aware image dataset analytics and compression on Spark."""

__version__ = "0.1.0"
