"""Jobs over many repositories at once: DataFrames in, DataFrames out."""
