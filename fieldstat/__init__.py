"""Mass-univariate statistics of grouped, high-dimensional data as Spark plans."""
