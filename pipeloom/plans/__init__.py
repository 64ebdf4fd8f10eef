"""From query documents to DataFrames."""
