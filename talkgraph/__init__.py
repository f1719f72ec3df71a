"""talkgraph: multimodal knowledge-graph building and querying as Spark DataFrame plans."""
