"""Imports every module that registers queries."""
from kinspark.plans import q_match  # noqa: F401
from kinspark.plans import q_sets  # noqa: F401
from kinspark.plans import q_agg  # noqa: F401
from kinspark.plans import q_window  # noqa: F401
from kinspark.plans import q_place  # noqa: F401
from kinspark.plans import q_source  # noqa: F401
from kinspark.plans import q_more  # noqa: F401
from kinspark.plans import q_full  # noqa: F401
