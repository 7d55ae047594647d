"""Document analytics on Spark: ingestion, chunking, retrieval, prompting and jobs as DataFrame operators."""
