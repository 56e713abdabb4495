"""Operators for training text and training vectors. Nothing else in the library imports this package."""

MODULES = ["token_queries", "quantile_queries", "conversation_queries", "neighbour_queries", "answer_queries", "leakage_queries", "mixing_queries", "mojibake_queries"]
