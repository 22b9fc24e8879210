"""millrace: corpus-scale text compliance and curation on Spark DataFrames."""
