"""All named queries; importing the modules fills the registry."""

from broadsheet.plans import (  # noqa: F401
    duplicate_queries,
    planning_queries,
    report_queries,
    rule_queries,
    selection_queries,
    source_queries,
    state_queries,
    stream_queries,
    text_queries,
)
from broadsheet.plans.registry import CHECKS, PLANS  # noqa: F401
