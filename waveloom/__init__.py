"""Analytics over time-ordered signals, fingerprints and matches, as Spark DataFrames."""
