"""Read analytics on Spark: k-mer counting, coverage models, correction, evaluation."""

__version__ = "0.1.0"
