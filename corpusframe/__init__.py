"""corpusframe: page-structured document corpora as Spark tables."""
