"""A Spark engine for scholarly documents, their bibliographies and text corpora."""
