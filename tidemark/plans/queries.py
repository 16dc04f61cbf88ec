"""All registered queries of the library's own operators."""

from . import entries, hurst_warnings, proximity_networks, rolling_regime, scaling_states, visibility_graphs
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "entries", "hurst_warnings", "proximity_networks", "rolling_regime", "scaling_states", "visibility_graphs"]
