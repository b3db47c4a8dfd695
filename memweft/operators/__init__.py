"""DataFrame-in, DataFrame-out operators of the recall engine."""
