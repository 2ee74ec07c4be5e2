"""Named queries over the fixture views; importing this package registers all."""

from tavola.plans import registry
from tavola.plans import reports, datasets, mining, lifecycle, recommend, smart_basket, campaigns, models, streams, extras  # noqa: F401

QUERIES = registry.QUERIES
ORACLE = registry.ORACLE
