"""millrace: Spark-native business analytics, planning, risk and retrieval operators."""

from millrace.session import build_session

__all__ = ["build_session"]
