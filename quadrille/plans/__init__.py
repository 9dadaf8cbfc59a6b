"""Query languages, their algebra, and its compilation to DataFrames."""
