"""docweave: record linkage and document processing over Spark DataFrames."""
