"""Document retrieval and citation-audit analytics on Spark."""
