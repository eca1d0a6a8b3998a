"""Structured Streaming over the same transition functions as the batch folds."""
