"""millrace: Spark-first data operators for training-data work."""

from __future__ import annotations

__version__ = "0.1.0"
