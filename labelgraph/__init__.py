"""labelgraph: relational operators over positioned text tokens, on Spark."""
