"""Training-data operators; ``dpspark.llm.queries`` registers them."""
