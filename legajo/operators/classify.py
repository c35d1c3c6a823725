"""Rule-based classification of a documents table with a ``text`` column.

Each operator works in two projections and never shuffles: the first scans the text once for every
literal of the rules, the second evaluates the rules over that scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legajo.functions import scoring as sc
from legajo.functions.text import SCAN_COLUMNS, Scan, dictionary, unguarded
from legajo.rules import agro, commercial, patterns, types
from legajo.rules.edit import Rules

RULE_METHODS = ("keyword", "regex", "agro", "commercial")
DOMAINS = {"agro": agro, "commercial": commercial}


def rule_votes(
    docs: DataFrame, methods: Sequence[str] = RULE_METHODS, keywords: Rules = types.TYPE_KEYWORDS,
    exprs: Rules = patterns.TYPE_PATTERNS,
) -> DataFrame:
    """Add one ``struct<type, confidence>`` column per method; the text is scanned once for all.

    ``keywords`` and ``exprs`` replace the rule tables of the keyword and the pattern method.
    """
    known = {"keyword": sc.keyword_dictionary(keywords), "regex": sc.pattern_dictionary(exprs)}
    known |= {name: sc.domain_dictionary(rules) for name, rules in DOMAINS.items()}
    scan = Scan(x for m in methods for x in known[m])
    scanned, t = scan.add_to(docs, types.OPENING_WORDS if "keyword" in methods else 0)
    tested = [p for group in exprs.values() for p in group] if "regex" in methods else []
    tested += [p for m in methods if m in DOMAINS for p in sc.domain_patterns(DOMAINS[m])]
    best = {"_may_score": t.may_score(unguarded(tested))}
    for m in methods:
        if m == "keyword":
            best["_keyword"] = sc.keyword_best(t, keywords)
        elif m == "regex":
            best["_regex"] = sc.pattern_best(t, exprs)
        else:
            best[f"_{m}"] = sc.domain_best(t, DOMAINS[m])
            best[f"_{m}_bonus"] = sc.domain_bonus(t, DOMAINS[m])
    kept = [F.col(c) for c in docs.columns]
    scored = scanned.select(*kept, *[F.expr(sql).alias(name) for name, sql in best.items()])
    may_score = F.col("_may_score")
    votes = []
    for m in methods:
        b = F.col(f"_{m}")
        if m == "keyword":
            vote = sc.keyword_decision(b)
        else:
            vote = sc.scored_decision(b, F.col(f"_{m}_bonus") if m in DOMAINS else None)
        votes.append(F.when(may_score, vote).otherwise(sc.no_vote()).alias(m))
    return scored.select(*kept, *votes)


def keyword_details(docs: DataFrame) -> DataFrame:
    """Add ``scores`` (all types) and ``keywords_found`` (types with a hit), both maps."""
    scanned, t = Scan(sc.keyword_dictionary()).add_to(docs, types.OPENING_WORDS)
    hits = scanned.withColumns({"scores": F.expr(sc.as_map(sc.keyword_type_scores(t))), "_hits": F.expr(sc.keyword_hits(t))})
    return hits.withColumn("keywords_found", sc.keyword_found("_hits")).drop("_hits", *SCAN_COLUMNS)


def pattern_details(docs: DataFrame, only: str | None = None) -> DataFrame:
    """One row per document, type and pattern that matched, with the matches."""
    rules = {k: v for k, v in patterns.TYPE_PATTERNS.items() if only in (None, k)}
    scanned, t = Scan(sc.pattern_dictionary(rules)).add_to(docs)
    return scanned.select("doc_id", F.explode(F.expr(sc.pattern_matches(t, rules))).alias("m")).select(
        "doc_id", "m.type", "m.pattern_no", "m.pattern", "m.matches", F.size("m.matches").alias("n_matches")
    )


def document_structure(docs: DataFrame) -> DataFrame:
    """Add the four structure flags and their mean."""
    scanned, t = Scan(dictionary(patterns=sc.STRUCTURE_PATTERNS)).add_to(docs)
    flagged = scanned.withColumns({k: F.expr(v) for k, v in sc.structure_flags(t).items()}).drop(*SCAN_COLUMNS)
    hits = sum((F.col(f).cast("int") for f in sc.STRUCTURE_FLAGS), F.lit(0))
    return flagged.withColumn("structure_score", hits / F.lit(4.0))


def term_profile(docs: DataFrame, terms: Sequence[str] = tuple(types.PROFILE_TERMS)) -> DataFrame:
    """One row per document and term that occurs in it."""
    scanned, t = Scan(dictionary(terms=terms)).add_to(docs)
    return scanned.select("doc_id", F.explode(F.expr(sc.term_counts(t, terms))).alias("c")).select(
        "doc_id", "c.term", "c.n"
    )
