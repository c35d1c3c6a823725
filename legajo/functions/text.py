"""Text primitives shared by every scorer: binding, term counts, opening words, search patterns.

Scorers hold dozens of tests over one text. ``let`` binds the prepared text once per row, so the
lower-cased form is not recomputed per rule and the plan stays one small expression per scorer
(a flat projection of all rules exceeds the JVM method-size limit of generated code).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, reduce
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

try:  # Python 3.11 moved the regular-expression parser
    from re import _parser as _regex_parser
except ImportError:  # pragma: no cover
    import sre_parse as _regex_parser

# Java flags that give the meaning the patterns were written for: Unicode classes, "." stopping
# only at a line feed; on top of it letter case is ignored, or "^" and "$" work per line.
PLAIN = "(?Ud)"
MULTILINE = "(?Udm)"
ANY_CASE = "(?iUd)"
ANY_CASE_MULTILINE = "(?iUdm)"

MIN_GUARD_LENGTH = 2
MAX_GUARD_CHOICES = 6
BRANCH_GROUP = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.transform(F.array(value), body)[0]


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def total(points: Iterable[Column]) -> Column:
    """Sum from left to right, so that floating-point results are reproducible."""
    return reduce(lambda a, b: a + b, points, F.lit(0.0))


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def opening_words(text: Column, count: int) -> Column:
    """The first ``count`` words joined by single spaces; the rest of the text is not split."""
    head = F.regexp_extract(text, rf"(?U)^\s*+(\S++(?:\s++\S++){{0,{count - 1}}}+)", 1)
    return F.regexp_replace(head, r"(?U)\s+", " ")


# Rules become SQL text, since a rule set has thousands of expression nodes and each Column call is a
# round trip to the JVM. The helpers below return SQL; ``F.expr`` takes the finished expression.


def quoted(value: str) -> str:
    if "'" in value or "\n" in value:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
    return f"r'{value}'"


def number(value: float) -> str:
    return f"{float(value)!r}D"


def sum_of(points: Iterable[str]) -> str:
    """Sum from left to right, starting at zero."""
    return f"({' + '.join(['0.0D', *points])})"


def points_if(test: str, points: float) -> str:
    return f"CASE WHEN {test} THEN {number(points)} ELSE 0.0D END"


def one_of(tests: Iterable[str]) -> str:
    found = list(tests)
    return f"({' OR '.join(found)})" if found else "false"


def occurrences(text: str, term: str) -> str:
    """Non-overlapping occurrences of ``term``."""
    cut = f"replace({text}, {quoted(term)}, '')"
    return f"CAST((char_length({text}) - char_length({cut})) / {len(term)} AS INT)"


def _choices(parsed) -> list[str] | None:
    """Literals of which at least one is part of every match; None when nothing is certain."""
    candidates: list[list[str]] = []
    run = ""

    def close() -> None:
        nonlocal run
        if run:
            candidates.append([run])
        run = ""

    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            run += chr(value)
            continue
        close()
        if name == "SUBPATTERN":
            inner = _choices(value[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] >= 1:
            inner = _choices(value[2])
        elif name == "BRANCH":
            parts = [_choices(branch) for branch in value[1]]
            inner = None if any(p is None for p in parts) else [x for p in parts for x in p]
        else:
            inner = None
        if inner:
            candidates.append(inner)
    close()
    if not candidates:
        return None
    return max(candidates, key=lambda c: (min(map(len, c)), -len(c)))


@lru_cache(maxsize=None)
def guard_literals(pattern: str) -> tuple[str, ...]:
    """Literals that every match must contain (any one of them), or () when no cheap test exists.

    A plain substring test is several times cheaper than a regular expression, and most patterns
    are absent from most documents, so the test decides almost every case.
    """
    if is_literal(pattern):
        return (literal_text(pattern),)
    found = _choices(_regex_parser.parse(pattern))
    if not found or min(map(len, found)) < MIN_GUARD_LENGTH or len(found) > MAX_GUARD_CHOICES:
        return ()
    return tuple(dict.fromkeys(found))


def _trie_pattern(literals: Iterable[str]) -> str:
    """One expression that matches the longest of the literals at a position."""
    tree: dict = {}
    for literal in literals:
        node = tree
        for char in literal:
            node = node.setdefault(char, {})
        node[""] = {}

    def render(node: dict) -> str:
        branches = [re.escape(c) + render(child) for c, child in sorted(node.items()) if c]
        if not branches:
            return ""
        if len(branches) > BRANCH_GROUP:
            # A character class in front of each group lets most positions skip its branches.
            letters = sorted(c for c in node if c)
            groups = [slice(i, i + BRANCH_GROUP) for i in range(0, len(letters), BRANCH_GROUP)]
            branches = [
                f"(?=[{re.escape(''.join(letters[g]))}])(?:{'|'.join(branches[g])})" for g in groups
            ]
        body = branches[0] if len(branches) == 1 and "" not in node else f"(?:{'|'.join(branches)})"
        return body + ("?" if "" in node else "")

    return render(tree)


HEX_DIGITS = {"x": 2, "u": 4, "U": 8}


def _lower(char: str, pattern: str) -> str:
    low = char.lower()
    if len(low) != 1:
        raise ValueError(f"{char!r} has no single lower-case letter: {pattern}")
    return low


def _ranges(parsed) -> Iterator[tuple[int, int]]:
    """Every character range in a parsed pattern."""
    for item in parsed if isinstance(parsed, (list, tuple, _regex_parser.SubPattern)) else ():
        if isinstance(item, tuple) and len(item) == 2 and str(item[0]) == "RANGE":
            yield item[1]
        else:
            yield from _ranges(item)


@lru_cache(maxsize=None)
def lowered(pattern: str) -> str:
    """The pattern that finds in a lower-cased text what ``pattern`` finds in the text regardless of case.

    Only literals and ends of ranges change; classes, anchors and group names stay. Raises ``ValueError`` for
    what has no such form: a range that holds letters of one case and other characters, named characters,
    octal escapes, flags other than ``i m s x``.
    """
    for low, high in _ranges(_regex_parser.parse(pattern)):
        want = {chr(c).lower() for c in range(low, high + 1)}
        ends = ord(_lower(chr(low), pattern)), ord(_lower(chr(high), pattern))
        if any(len(c) == 1 and not ends[0] <= ord(c) <= ends[1] for c in want) or (
            ends != (low, high) and len(want) != ends[1] - ends[0] + 1
        ):
            raise ValueError(f"range {chr(low)}-{chr(high)} cannot be lower-cased: {pattern}")
    out, i = [], 0
    while i < len(pattern):
        special = re.match(r"\(\?P<\w+>|\(\?P=\w+\)|\(\?[a-zA-Z]+(?:-[a-zA-Z]+)?[:)]", pattern[i:])
        if pattern[i] == "\\":
            kind = pattern[i + 1]
            if kind in HEX_DIGITS:
                end = i + 2 + HEX_DIGITS[kind]
                out.append(re.escape(_lower(chr(int(pattern[i + 2 : end], 16)), pattern)))
                i = end
                continue
            if kind == "N" or kind == "0" or re.match(r"[0-7]{3}", pattern[i + 1 :]):
                raise ValueError(f"write the character instead of its name or octal number: {pattern}")
            out.append(pattern[i : i + 2])
            i += 2
        elif special:
            if special[0][2] != "P" and set(special[0][2:-1]) - set("imsx-"):
                raise ValueError(f"flags {special[0]!r} are not known: {pattern}")
            out.append(special[0])
            i += len(special[0])
        else:
            out.append(_lower(pattern[i], pattern))
            i += 1
    return "".join(out)


def java(pattern: str) -> str:
    """The same pattern in the engine's syntax: groups by number, ``\\Z`` only at the very end."""
    groups = re.compile(pattern).groupindex

    def other(m: re.Match) -> str:
        if m[0].startswith("(?P<"):
            return "("
        if m[0].startswith("(?P="):
            return f"(?:\\{groups[m[0][4:-1]]})"
        return "\\z" if m[0] == "\\Z" else m[0]

    return re.sub(r"\\.|\(\?P<\w+>|\(\?P=\w+\)", other, pattern, flags=re.S)


@lru_cache(maxsize=None)
def is_literal(pattern: str) -> bool:
    return all(str(op) == "LITERAL" for op, _ in _regex_parser.parse(pattern))


def literal_text(pattern: str) -> str:
    return "".join(chr(value) for _, value in _regex_parser.parse(pattern))


def dictionary(patterns: Iterable[str] = (), terms: Iterable[str] = ()) -> set[str]:
    """Literals a ``Scan`` must know before these patterns and terms can be tested."""
    return {t.lower() for t in terms} | {x for p in patterns for x in guard_literals(lowered(p))}


def unguarded(patterns: Iterable[str]) -> list[str]:
    """Lower-cased patterns without a literal that every match contains."""
    return [p for p in dict.fromkeys(lowered(x) for x in patterns) if not guard_literals(p)]


WORD_BITS = 62
#: Maps over which the masks of a scan's literals are spread.
MASK_MAPS = 64


class Scan:
    """One pass over a text that finds which literals of a dictionary it contains.

    A single expression collects the longest literal that starts at each position (a look-ahead, so
    overlapping ones are kept); every shorter literal at that position is a prefix of it. The result
    is a bit set, so hundreds of presence tests cost a few machine words per document, however long
    the document is, and the regular expressions run only where their literals occur.
    """

    def __init__(self, literals: Iterable[str], upper: bool = False):
        self.literals = sorted(set(literals))
        self._fold = F.upper if upper else F.lower
        self.slot = {x: divmod(i, WORD_BITS) for i, x in enumerate(self.literals)}
        self.words = max(1, -(-len(self.literals) // WORD_BITS))

    def _mask_of(self, found: str) -> str:
        """The bits of the collected literal ``found`` and of its prefixes. A map is searched entry by entry, so the
        literals lie in short maps by their checksum."""
        none = f"array({', '.join(['0L'] * self.words)})"
        maps: list[list[str]] = [[] for _ in range(MASK_MAPS)]
        for literal in self.literals:
            words = [0] * self.words
            for n in range(1, len(literal) + 1):
                if literal[:n] in self.slot:
                    word, bit = self.slot[literal[:n]]
                    words[word] |= 1 << bit
            entry = f"{quoted(literal)}, array({', '.join(f'{w}L' for w in words)})"
            maps[crc32(literal.encode()) % MASK_MAPS].append(entry)
        held = ", ".join(f"map({', '.join(entries or [f"'', {none}"])})" for entries in maps)
        return f"element_at(array({held})[pmod(crc32(CAST({found} AS BINARY)), {MASK_MAPS}L)], {found})"

    def _bits(self, folded: str) -> Column:
        trie = quoted(f"(?=({_trie_pattern(self.literals)}))")
        masks = (
            f"transform(array_distinct(regexp_extract_all({folded}, {trie}, 1)), "
            f"found -> {self._mask_of('found')})"
        )
        words = ", ".join(
            f"aggregate(masks, 0L, (bits, mask) -> bits | mask[{w}])" for w in range(self.words)
        )
        return F.expr(f"transform(array({masks}), masks -> array({words}))[0]")

    def add_to(self, docs: DataFrame, opening: int = 0) -> tuple[DataFrame, ScannedText]:
        """Add the scan of column ``text`` under ``SCAN_COLUMNS``; ``opening`` also keeps that many
        words from the start."""
        docs = docs.withColumn("_folded", self._fold(text_or_empty(F.col("text"))))
        added = {"_bits": self._bits("_folded") if self.literals else F.array().cast("array<bigint>")}
        if opening:
            added["_opening"] = opening_words(F.col("_folded"), opening)
        return docs.withColumns(added), ScannedText(self)


SCAN_COLUMNS = ("_folded", "_bits", "_opening")


class ScannedText:
    """Tests over one scanned text; letter case is ignored as long as the literals are folded alike."""

    text = "coalesce(text, '')"
    folded = "_folded"
    opening = "_opening"

    def __init__(self, scan: Scan):
        self._scan = scan

    def may_score(self, unguarded: Iterable[str] = ()) -> str:
        """Whether any dictionary literal occurs, or any pattern that has no literal to look for.

        The higher-order function also keeps its projection out of whole-stage code generation, whose
        single method cannot hold hundreds of rules; the projection is then compiled in small methods.
        """
        tests = [f"rlike({self.folded}, {quoted(MULTILINE + java(p))})" for p in unguarded]
        return one_of(["exists(_bits, word -> word != 0)", *tests])

    def has_any(self, literals: Iterable[str]) -> str:
        """Whether any of these dictionary literals occurs."""
        masks: dict[int, int] = {}
        for literal in literals:
            word, bit = self._scan.slot[literal]
            masks[word] = masks.get(word, 0) | (1 << bit)
        return one_of(f"(_bits[{word}] & {mask}L) != 0" for word, mask in masks.items())

    def has(self, literal: str) -> str:
        return self.has_any([literal])

    def count(self, literal: str) -> str:
        return f"CASE WHEN {self.has(literal)} THEN {occurrences(self.folded, literal)} ELSE 0 END"

    def guarded(self, pattern: str, result: str, otherwise: str) -> str:
        """``result`` where the literals of the pattern occur, else ``otherwise``."""
        literals = guard_literals(lowered(pattern))
        return f"CASE WHEN {self.has_any(literals)} THEN {result} ELSE {otherwise} END" if literals else result

    def match_count(self, pattern: str, flags: str = PLAIN) -> str:
        p = lowered(pattern)
        if is_literal(p):
            return self.count(literal_text(p))
        return self.guarded(pattern, f"regexp_count({self.folded}, {quoted(flags + java(p))})", "0")

    def matches(self, pattern: str, flags: str = PLAIN) -> str:
        return self.matches_any([pattern], flags)

    def matches_any(self, patterns: Iterable[str], flags: str = PLAIN) -> str:
        plain = [lowered(p) for p in patterns]
        words = [literal_text(p) for p in plain if is_literal(p)]
        tests = [self.has_any(words)] if words else []
        tests += [
            self.guarded(p, f"rlike({self.folded}, {quoted(flags + java(p))})", "false")
            for p in plain if not is_literal(p)
        ]
        return one_of(tests)

    def has_word(self, word: str) -> str:
        pattern = quoted(rf"(?U)\b{word}\b")
        return f"CASE WHEN {self.has(word)} THEN rlike({self.folded}, {pattern}) ELSE false END"

    def find_all(self, pattern: str, flags: str = ANY_CASE_MULTILINE) -> str:
        """All matches: the whole match without groups, the group when there is one, and the groups
        joined by a space when there are several."""
        groups = re.compile(pattern).groups
        parts = [
            f"regexp_extract_all({self.text}, {quoted(flags + java(pattern))}, {g})"
            for g in (range(1, groups + 1) if groups else [0])
        ]
        return reduce(lambda a, b: f"zip_with({a}, {b}, (x, y) -> concat_ws(' ', x, y))", parts)


def find_all(text: Column, pattern: str, group: int | None = None, flags: str = ANY_CASE) -> Column:
    """All matches: the whole match, or the given (or only) group."""
    groups = re.compile(pattern).groups
    return F.regexp_extract_all(text, F.lit(flags + pattern), F.lit(groups if group is None else group))


def find_first(text: Column, pattern: str, group: int = 0, flags: str = ANY_CASE) -> Column:
    """First match of a part that cannot be empty, NULL when there is none."""
    return F.nullif(F.regexp_extract(text, flags + pattern, group), F.lit(""))


def strip(text: Column) -> Column:
    """Trim every kind of whitespace on both sides."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def fixed(value: Column, digits: int) -> Column:
    """Decimal text with half-even rounding of the exact binary value."""
    return F.regexp_replace(F.format_number(value, digits), ",", "")
