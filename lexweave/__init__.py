"""Entity-resolution analytics on Spark DataFrames, and training-corpus operators in :mod:`lexweave.llm`."""
