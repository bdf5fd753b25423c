"""semblance: entity resolution and ranking over embedding tables, on Spark DataFrames."""
