"""Temporal patterns: a builder, a planner that makes native plans where it can, and a per-trace runner for the rest."""

from .builder import Channel, Pattern
from .plan import collect, match
from .records import MatchRecords
from .runner import PatternError

__all__ = ["Channel", "MatchRecords", "Pattern", "PatternError", "collect", "match"]
