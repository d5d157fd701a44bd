"""The registered queries over the driver tables; importing the modules registers them."""

from tallyloom.plans import composition, gates, intervals, records, relational, temporal, texts, workflow  # noqa: F401
from tallyloom.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
