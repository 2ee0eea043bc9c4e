"""Analytics over collections of labelled graphs, expressed as Spark DataFrame transformations."""
