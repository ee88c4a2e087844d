"""lectern: transcript, segment and corpus analytics expressed with Spark DataFrames and SQL."""
