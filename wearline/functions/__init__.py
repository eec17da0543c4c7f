"""Column-level helpers (built-in Spark expressions only, no Python UDFs)."""

from wearline.functions.columns import *  # noqa: F401,F403
from wearline.functions.constants import *  # noqa: F401,F403
