"""Document structuring on Spark: lines, segments, labels, pages, chunks, tasks and training-data operators."""

__version__ = "1.0.0"
