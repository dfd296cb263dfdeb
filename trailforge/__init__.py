"""Trailforge: road-network routing and trajectory analytics on PySpark."""

__version__ = "0.1.0"
