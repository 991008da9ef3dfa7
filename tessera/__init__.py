"""A Spark-native retrieval analytics engine."""

from tessera.session import get_session

__all__ = ["get_session"]
