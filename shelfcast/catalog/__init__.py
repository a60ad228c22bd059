"""Named queries over the given tables and their SQL."""

from . import sqlparts  # noqa: F401
from . import q_panel, q_features, q_inventory, q_eval, q_backtest, q_stream  # noqa: F401
from .base import REGISTRY

__all__ = ["REGISTRY"]
