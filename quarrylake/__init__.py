"""quarrylake: document recall, graph analysis and record hygiene as Spark DataFrame code."""
