"""All registered queries."""

from courtside.plans import apply_plans, booking_plans, discovery_plans, function_plans, profile_plans, social_plans, stream_plans  # noqa: F401
from courtside.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
