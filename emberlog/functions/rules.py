"""Ordered rules over text as small expressions: one look at all patterns, then the first that hits."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, functions as F

from ..plans.rulebook import NORMAL_TYPE, RULES
from .text import regex


def hits(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(regex(pattern, ignore_case=True)))


def any_hits(text: Column, patterns: Iterable[str]) -> Column:
    """Whether some pattern hits: one pattern of alternatives, one pass over the text.

    Patterns of whole words share their word bounds, so the alternatives are tried at word starts only.
    """
    patterns = list(patterns)
    bodies = [re.fullmatch(r"\\b\((.*)\)\\b", p) for p in patterns]
    if all(bodies):
        return hits(text, r"\b(?:" + "|".join(f"(?:{m.group(1)})" for m in bodies) + r")\b")
    return hits(text, "|".join(f"(?:{p})" for p in patterns))


def listed(rules: Mapping[str, Sequence[str]]) -> list[tuple[str, str]]:
    """(category, pattern) in order of declaration."""
    return [(category, pattern) for category, patterns in rules.items() for pattern in patterns]


def rule_number(text: Column, rules: Mapping[str, Sequence[str]] = RULES) -> Column:
    """Number of the first pattern that hits, null if none; most logs are normal and looked at once."""
    patterns = [p for _, p in listed(rules)]
    chain = F.when(~any_hits(text, patterns), F.lit(None).cast("int"))
    for number, pattern in enumerate(patterns):
        chain = chain.when(hits(text, pattern), number)
    return chain


def log_type_of(text: Column, rules: Mapping[str, Sequence[str]] = RULES) -> Column:
    """Only the category of the first pattern that hits."""
    chain = F.when(~any_hits(text, [p for _, p in listed(rules)]), NORMAL_TYPE)
    for category, patterns in rules.items():
        chain = chain.when(any_hits(text, patterns), category)
    return chain


def rule_confidence(text: Column, rule: Column, rules: Mapping[str, Sequence[str]],
                    weights: Mapping[str, float]) -> Column:
    """Weight, plus at most 0.3 for a long pattern, plus 0.05 per keyword found up to 0.2; at most 0.98."""
    base = F.array(*[F.lit(weights.get(c, 0.7) + min(len(p) / 50.0, 0.3)) for c, p in listed(rules)])
    keywords = F.array(*[F.array(*[F.lit(k) for k in re.findall(r"\w+", p.lower())]) for _, p in listed(rules)])
    found = F.size(F.filter(F.get(keywords, rule), lambda k: F.contains(text, k)))
    return F.round(F.least(F.get(base, rule) + F.least(found * 0.05, F.lit(0.2)), F.lit(0.98)), 3)
