"""Scoring methods as Column expressions. Each returns ``struct<type, confidence>``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from legajo.functions import text as tx
from legajo.rules import agro, commercial, patterns, types
from legajo.rules.types import UNKNOWN


def vote(type_: Column, confidence: Column) -> Column:
    return F.struct(type_.alias("type"), confidence.cast("double").alias("confidence"))


def no_vote() -> Column:
    return vote(F.lit(UNKNOWN), F.lit(0.0))


def ranked(scores: Mapping[str, str]) -> str:
    """The best ``struct<score, rank, type>``; of equal scores the first declared type wins."""
    entries = ", ".join(
        f"named_struct('score', CAST({score} AS DOUBLE), 'rank', {-i}, 'type', {tx.quoted(name)})"
        for i, (name, score) in enumerate(scores.items())
    )
    return f"array_max(array({entries}))"


def as_map(values: Mapping[str, str]) -> str:
    return f"map({', '.join(f'{tx.quoted(name)}, {value}' for name, value in values.items())})"


# ---------------------------------------------------------------- keyword method


def _longest_word(keyword: str) -> str:
    return max(keyword.split(), key=len)


def keyword_dictionary(rules=types.TYPE_KEYWORDS) -> set[str]:
    terms = [k.lower() for keywords in rules.values() for k in keywords]
    return tx.dictionary(terms=[*terms, *map(_longest_word, terms)])


def _keyword_points(t: tx.ScannedText, keyword: str) -> str:
    k = keyword.lower()
    early = f"{t.has(_longest_word(k))} AND contains({t.opening}, {tx.quoted(k)})"
    return (
        f"({t.count(k)} * {tx.number(types.POINTS_PER_OCCURRENCE)}"
        f" + {tx.points_if(early, types.POINTS_IN_OPENING)})"
    )


def keyword_type_scores(t: tx.ScannedText, rules=types.TYPE_KEYWORDS) -> dict[str, str]:
    return {
        name: f"least({tx.sum_of(_keyword_points(t, k) for k in keywords)}, 1.0D)"
        for name, keywords in rules.items()
    }


def keyword_best(t: tx.ScannedText, rules=types.TYPE_KEYWORDS) -> str:
    return ranked(keyword_type_scores(t, rules))


def keyword_decision(best: Column, threshold=types.KEYWORD_THRESHOLD) -> Column:
    return vote(F.when(best["score"] < threshold, UNKNOWN).otherwise(best["type"]), best["score"])


def keyword_hits(t: tx.ScannedText, rules=types.TYPE_KEYWORDS) -> str:
    """Keywords found, an array for each type in declared order, NULL for a type without any; within an array NULL for
    each keyword that is not found. To be a column of its own before ``keyword_found``: inside a higher-order function
    the tests would be interpreted one by one instead of compiled."""
    found = ", ".join(
        f"CASE WHEN {t.has_any(k.lower() for k in keywords)} THEN array(" + ", ".join(
            f"CASE WHEN {t.has(k.lower())} THEN {tx.quoted(k)} END" for k in keywords) + ") END"
        for keywords in rules.values()
    )
    return f"array({found})"


def keyword_found(hits: str, rules=types.TYPE_KEYWORDS) -> Column:
    """Keywords found per type, types without any left out, from the column of ``keyword_hits``."""
    names = F.array(*[F.lit(name) for name in rules])
    return F.map_from_arrays(
        F.filter(names, lambda _, i: F.get(hits, i).isNotNull()),
        F.transform(F.filter(hits, lambda h: h.isNotNull()), lambda h: F.array_compact(h)),
    )


def term_counts(t: tx.ScannedText, terms: Sequence[str]) -> str:
    """Occurrences of chosen terms, as ``array<struct<term, n>>`` of positive counts."""
    counts = ", ".join(f"named_struct('term', {tx.quoted(x)}, 'n', {t.count(x)})" for x in terms)
    return f"filter(array({counts}), c -> c.n > 0)"


def first_match_type(text: Column, rules=types.FIRST_MATCH_TERMS) -> Column:
    """Earlier classifier: the first listed type with a term in the text."""

    def choose(t: Column) -> Column:
        chain = None
        for name, terms in rules:
            hit = tx.any_of(F.contains(t, F.lit(x)) for x in terms)
            chain = F.when(hit, name) if chain is None else chain.when(hit, name)
        return chain.otherwise(UNKNOWN)

    return tx.let(F.lower(tx.text_or_empty(text)), choose)


# ---------------------------------------------------------------- pattern method


def pattern_dictionary(rules=patterns.TYPE_PATTERNS) -> set[str]:
    return tx.dictionary(patterns=[p for exprs in rules.values() for p in exprs])


def pattern_best(t: tx.ScannedText, rules=patterns.TYPE_PATTERNS, per_pattern=patterns.MATCHES_PER_PATTERN) -> str:
    def score(exprs: Sequence[str]) -> str:
        points = tx.sum_of(f"least({t.match_count(p, tx.MULTILINE)}, {per_pattern})" for p in exprs)
        return f"least({points} / {tx.number(len(exprs) * per_pattern)}, 1.0D)"

    return ranked({name: score(exprs) for name, exprs in rules.items() if exprs})


def scored_decision(best: Column, bonus: Column | None = None) -> Column:
    """The best type if it scored at all; a bonus is added to a positive score only."""
    score = best["score"] if bonus is None else F.least(best["score"] + bonus, F.lit(1.0))
    return F.when(best["score"] > 0, vote(best["type"], score)).otherwise(no_vote())


def pattern_matches(t: tx.ScannedText, rules=patterns.TYPE_PATTERNS) -> str:
    """Matches per pattern: ``array<struct<type, pattern_no, pattern, matches>>`` without misses."""
    none = "CAST(array() AS array<string>)"
    entries = ", ".join(
        f"named_struct('type', {tx.quoted(name)}, 'pattern_no', {i + 1}, 'pattern', {tx.quoted(p)}, "
        f"'matches', {t.guarded(p, t.find_all(p), none)})"
        for name, exprs in rules.items() for i, p in enumerate(exprs)
    )
    return f"filter(array({entries}), e -> size(e.matches) > 0)"


STRUCTURE_PATTERNS = [*patterns.TABLE_PATTERNS, *patterns.TOTAL_PATTERNS, *patterns.TAX_PATTERNS]
STRUCTURE_FLAGS = ("has_header", "has_table", "has_totals", "tax_compliant")


def structure_flags(t: tx.ScannedText) -> dict[str, str]:
    """Header, table, totals and tax-authority marks."""
    tax = " + ".join(f"CAST({t.matches(p)} AS INT)" for p in patterns.TAX_PATTERNS)
    return {
        "has_header": tx.one_of(f"rlike({t.text}, {tx.quoted(tx.MULTILINE + p)})" for p in patterns.HEADER_PATTERNS),
        "has_table": t.matches_any(patterns.TABLE_PATTERNS),
        "has_totals": t.matches_any(patterns.TOTAL_PATTERNS),
        "tax_compliant": f"({tax}) >= {patterns.TAX_MINIMUM}",
    }


# ---------------------------------------------------------------- domain methods


def domain_patterns(rules) -> list[str]:
    exprs = [p for spec in rules.TYPES.values() for p in spec["patterns"]]
    return exprs + [p for group in rules.ELEMENTS.values() for p in group]


def domain_dictionary(rules) -> set[str]:
    terms = [k for spec in rules.TYPES.values() for k in spec["keywords"]]
    terms += [term for _, _, _, names in rules.BONUS for term in names]
    return tx.dictionary(domain_patterns(rules), terms)


def _repeat_sum(points: float, times: int) -> float:
    result = 0.0
    for _ in range(times):
        result += points
    return result


def _domain_type_score(t: tx.ScannedText, rules, spec: Mapping[str, Sequence[str]]) -> str:
    keyword = tx.sum_of(tx.points_if(t.has(k), rules.POINTS_KEYWORD) for k in spec["keywords"])
    pattern = tx.sum_of(f"{tx.number(rules.POINTS_MATCH)} * {t.match_count(p)}" for p in spec["patterns"])
    found = " + ".join(
        f"CAST({t.matches_any(rules.ELEMENTS.get(e, []))} AS INT)" for e in spec["required"]
    )
    needed = len(spec["required"])
    # Indexed by the number of elements found: their points, and the factor for missing ones.
    points = ", ".join(tx.number(_repeat_sum(rules.POINTS_REQUIRED, n)) for n in range(needed + 1))
    factor = ", ".join(tx.number(0.5 + 0.5 * (n / needed)) for n in range(needed + 1))
    return (
        f"least(({keyword} + {pattern} + array({points})[{found}]) * array({factor})[{found}], 1.0D)"
    )


def domain_bonus(t: tx.ScannedText, rules) -> str:
    terms = (
        tx.points_if(t.has_word(term) if whole else t.has(term), points)
        for _, points, whole, names in rules.BONUS for term in names
    )
    return f"least({tx.sum_of(terms)}, {tx.number(rules.BONUS_LIMIT)})"


def domain_best(t: tx.ScannedText, rules) -> str:
    """Keywords, pattern matches and required elements per type."""
    return ranked({name: _domain_type_score(t, rules, spec) for name, spec in rules.TYPES.items()})


def in_domain(confidence: Column, threshold: float) -> Column:
    return confidence > threshold



def agro_indicators(text: Column) -> Column:
    """Grains, weights, prices, quality values and dates named in the text, as string arrays."""

    def extract(t: Column) -> Column:
        weight = F.zip_with(
            tx.find_all(t["text"], agro.WEIGHT, 1), tx.find_all(t["text"], agro.WEIGHT, 2),
            lambda n, unit: F.concat_ws(" ", n, unit),
        )
        quality = F.zip_with(
            tx.find_all(t["text"], agro.QUALITY, 1), tx.find_all(t["text"], agro.QUALITY, 2),
            lambda name, n: F.concat(name, F.lit(": "), n, F.lit("%")),
        )
        return F.struct(
            F.filter(F.array(*[F.lit(g) for g in agro.GRAINS]), lambda g: F.contains(t["lower"], g))
            .alias("grains_mentioned"),
            weight.alias("weights_found"),
            F.concat(*[tx.find_all(t["text"], p) for p in agro.PRICES]).alias("prices_found"),
            quality.alias("quality_params"),
            tx.find_all(t["text"], agro.DATE, flags=tx.PLAIN).alias("dates_found"),
        )

    full = tx.text_or_empty(text)
    return tx.let(F.struct(full.alias("text"), F.lower(full).alias("lower")), extract)


def commercial_indicators(text: Column) -> Column:
    """Amounts, account numbers, banks, payment methods and dates, as string arrays."""

    def extract(t: Column) -> Column:
        amounts = F.concat(*[tx.find_all(t, p) for p in commercial.AMOUNTS])
        return F.struct(
            F.transform(amounts, lambda a: F.concat(F.lit("$"), a)).alias("amounts_found"),
            F.concat(*[tx.find_all(t, p) for p in commercial.ACCOUNTS]).alias("account_numbers"),
            F.concat(*[tx.find_all(t, p) for p in commercial.BANKS]).alias("banks_mentioned"),
            tx.find_all(t, commercial.PAYMENT).alias("payment_methods"),
            tx.find_all(t, commercial.DATE, flags=tx.PLAIN).alias("dates_found"),
        )

    return tx.let(tx.text_or_empty(text), extract)
