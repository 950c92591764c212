"""plexmat: matrix and network analytics expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
