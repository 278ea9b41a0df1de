"""Operators for large-scale training-data pipelines (text filters, dedup,
tokens, chat formatting, packing). Nothing outside this folder imports it."""
