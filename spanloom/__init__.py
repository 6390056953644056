"""Analytics over time-stamped, labelled interval relations, as Spark DataFrame plans."""
