"""tallystream: chat and legal-question processing, and corpus preparation, on Spark DataFrames."""
