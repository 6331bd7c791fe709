"""A Spark-native engine for message corpora: ingest, entity graph, access control, quality measures."""
