"""All registered queries (importing the plan modules fills the registry)."""

from wearline.plans import closed_form, drift, files, live, models, rul, snapshot, streams  # noqa: F401
from wearline.plans.registry import OPERATORS, ORACLE, QUERIES  # noqa: F401
