"""Edits of rule tables; each returns a new table, to be passed to the scoring operators."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from legajo.functions.text import lowered

Rules = Mapping[str, Sequence[str]]


def with_type(rules: Rules, doc_type: str, values: Sequence[str]) -> Rules:
    """Add a type, or replace the values of one that exists (it keeps its rank)."""
    return {**rules, doc_type: list(values)}


def with_updated_type(rules: Rules, doc_type: str, values: Sequence[str]) -> Rules:
    """Replace the values of a type that exists; an unknown type changes nothing."""
    return with_type(rules, doc_type, values) if doc_type in rules else rules


def with_pattern(rules: Rules, doc_type: str, pattern: str) -> Rules:
    """Append a pattern to a type; raises ``ValueError`` when it is not a regular expression, or not one that can
    be matched regardless of letter case (see ``functions.text.lowered``)."""
    try:
        re.compile(pattern)
        lowered(pattern)
    except re.error as e:
        raise ValueError(f"invalid pattern {pattern!r}: {e}") from e
    return {**rules, doc_type: [*rules.get(doc_type, []), pattern]}
