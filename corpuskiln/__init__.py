"""corpuskiln: corpus curation and evaluation analytics as declarative PySpark plans."""

__version__ = "0.1.0"
