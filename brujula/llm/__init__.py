"""Operators for preparing text corpora for language models. Nothing outside imports this package."""
