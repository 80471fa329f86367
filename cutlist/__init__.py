"""Media-metadata analytics on Spark: packets, chunks, cues, fingerprints and plans as DataFrames."""
