"""docloom: documents to machine-learning tables on Spark."""
