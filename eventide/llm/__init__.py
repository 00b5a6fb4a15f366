"""Operators for training-data pipelines: one module an operator, each a function from documents to rows."""
