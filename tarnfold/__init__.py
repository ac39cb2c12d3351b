"""Analytics over repeatedly observed entities, written as Spark DataFrame operators."""
