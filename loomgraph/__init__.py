"""loomgraph: graph-and-text analytics expressed as Spark DataFrame plans."""
