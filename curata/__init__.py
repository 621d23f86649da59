"""Dataset curation and detector evaluation on Spark DataFrames."""
