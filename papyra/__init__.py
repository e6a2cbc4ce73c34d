"""papyra: document analytics on Spark DataFrames."""
