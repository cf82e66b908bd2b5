"""Rule packs that come with the engine."""

from __future__ import annotations

from functools import cache
from pathlib import Path

from vigilspark.operators.rules import RuleSet, rule_set


@cache
def own_rules() -> RuleSet:
    """The engine's own detection rules, read where the driver runs; tasks get their text."""
    return rule_set(Path(__file__).with_name("own.yar").read_text())
