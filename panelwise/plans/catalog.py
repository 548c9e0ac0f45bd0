"""All registered queries (importing the query modules fills the registry)."""

from panelwise.plans.registry import REGISTRY, Query  # noqa: F401
from panelwise.plans import q_panel, q_series, q_stats, q_ml  # noqa: F401,E402
