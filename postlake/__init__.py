"""postlake: mail-archive analytics and text-corpus preparation on Spark DataFrames."""
