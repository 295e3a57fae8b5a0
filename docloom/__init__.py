"""docloom: document-collection analytics expressed as Spark DataFrame jobs."""
