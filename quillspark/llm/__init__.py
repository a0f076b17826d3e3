"""Operators for building training data. Nothing outside this subpackage imports it."""

from quillspark.llm.queries import QUERIES, SQL  # noqa: F401
