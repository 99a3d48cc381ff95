"""All registered queries; importing the modules registers them."""

from drawbom.plans import (  # noqa: F401
    bom, chain, geometry, io, jobs, key_values, layout, page_triage, panels, rules_basic, rules_equipment, rules_parts, rules_search, schedules, text_reads,
)
from drawbom.plans.registry import CHECKS, PLANS  # noqa: F401
