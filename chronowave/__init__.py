"""Spark-native analytics for clock-synchronised signals and temporal patterns."""

from .frame import Frame, Wave
from .session import configure, session

__all__ = ["Frame", "Wave", "configure", "session"]
