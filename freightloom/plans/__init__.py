"""Queries by theme; importing this package registers them."""

from freightloom.plans import bundles, cards, cleaning, decisions, evaluations, features, further, generated, joins, matching, models, panels, reports, routing, runs, scalars, scores, text, variants  # noqa: F401
from freightloom.plans.registry import QUERIES  # noqa: F401
