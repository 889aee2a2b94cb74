"""DataFrame -> DataFrame operators: cleaning, reshaping, wells and curves, features, assays, comparisons, transitions."""
