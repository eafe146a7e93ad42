"""Read-collection analytics on Spark: suffix index, k-mer queries, codecs, alignment and assembly graphs."""

__version__ = "0.1.0"
