"""Selection, search, embedding and results, from DataFrames to DataFrames."""
