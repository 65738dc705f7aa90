"""Jobs over the ledger: DataFrames in, DataFrames out."""
