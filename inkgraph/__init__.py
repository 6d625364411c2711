"""inkgraph: document analytics and knowledge graphs as plain Spark DataFrame transformations."""

from inkgraph.session import build_session

__all__ = ["build_session"]
