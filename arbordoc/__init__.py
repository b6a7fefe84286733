"""Set-wise queries over corpora of structured document trees, as Spark DataFrame plans."""

__version__ = "0.1.0"
