"""Votes, consensus and the weighted decision."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legajo.functions import text as tx
from legajo.rules import ensemble as rules
from legajo.rules import messages as says
from legajo.rules.types import UNKNOWN
from legajo.session import broadcast_if_small, spread_nulls


def votes_long(docs: DataFrame, methods: Sequence[str]) -> DataFrame:
    """One row per document and method: ``doc_id, method, method_ord, type, confidence``."""
    rows = F.array(*[
        F.struct(
            F.lit(m).alias("method"), F.lit(rules.run_order(methods).index(m)).alias("method_ord"),
            F.col(f"{m}.type").alias("type"), F.col(f"{m}.confidence").alias("confidence"),
        )
        for m in methods
    ])
    return docs.select("doc_id", F.inline(rows))


def consensus_stats(votes: DataFrame) -> DataFrame:
    """Per document and type: votes, share of all votes, mean and highest confidence, methods. One grouping by
    document, of a handful of votes each; the types are told apart within the row."""
    vote = F.struct("method_ord", "method", "type", "confidence")
    active = votes.filter(F.col("confidence") > rules.VOTE_MINIMUM).groupBy("doc_id").agg(F.sort_array(F.collect_list(vote)).alias("_all"))
    types = active.select("doc_id", "_all", F.explode(F.array_distinct(F.transform("_all", lambda v: v["type"]))).alias("type"))
    own = types.withColumn("_own", F.filter("_all", lambda v: v["type"].eqNullSafe(F.col("type"))))
    points = F.aggregate("_own", F.lit(0.0), lambda total, v: total + v["confidence"])
    return own.select(
        "doc_id", "type", F.size("_own").cast("bigint").alias("vote_count"),
        (F.size("_own") / F.size("_all")).alias("vote_percentage"), (points / F.size("_own")).alias("avg_confidence"),
        F.array_max(F.transform("_own", lambda v: v["confidence"])).alias("max_confidence"),
        F.col("_own")[0]["method_ord"].alias("first_ord"), F.transform("_own", lambda v: v["method"]).alias("supporting_methods"),
    )


def best_consensus(stats: DataFrame) -> DataFrame:
    """The type with most votes, then the highest mean, then the earliest method."""
    best = stats.groupBy("doc_id").agg(
        F.max(F.struct("vote_count", "avg_confidence", (-F.col("first_ord")).alias("o"), "type")).alias("b"),
        F.sum("vote_count").alias("total_methods"),
    )
    strong = (F.col("b.vote_count") >= rules.STRONG_VOTES) & (F.col("b.avg_confidence") >= rules.STRONG_AVERAGE)
    return best.select(
        "doc_id", F.col("b.type").alias("best_consensus"), "b.vote_count", "b.avg_confidence",
        "total_methods", strong.alias("has_strong_consensus"),
    )


def weighted_scores(votes: DataFrame, weights: Mapping[str, float] = rules.WEIGHTS) -> DataFrame:
    """Sum of confidence times weight per document and type; a method without a weight is an error."""
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("method"))
    weight = F.coalesce(known, F.raise_error(F.concat(F.lit("no weight for method "), "method")).cast("double"))
    return (
        votes.filter(F.col("confidence") > 0)
        .groupBy("doc_id", "type").agg(F.sum(F.col("confidence") * weight).alias("score"))
    )


class _Votes:
    """Vote columns of one row, compared pairwise; a handful of methods needs no grouping."""

    def __init__(self, methods: Sequence[str], weights: Mapping[str, float]):
        missing = [m for m in methods if m not in weights]
        if missing:
            raise ValueError(f"no weight for {missing}")
        self.run = rules.run_order(methods)
        self.weighted = [m for m in weights if m in methods]
        self.weights = weights

    def type(self, m: str) -> Column:
        return F.col(f"{m}.type")

    def confidence(self, m: str) -> Column:
        return F.col(f"{m}.confidence")

    def active(self, m: str) -> Column:
        return self.confidence(m) > rules.VOTE_MINIMUM

    def scored(self, m: str) -> Column:
        return self.confidence(m) > 0

    def active_votes(self) -> Column:
        votes = F.array(*[
            F.struct(F.lit(m).alias("method"), self.type(m).alias("type"), self.confidence(m).alias("confidence"))
            for m in self.run
        ])
        return F.filter(votes, lambda v: v["confidence"] > rules.VOTE_MINIMUM)

    def consensus(self) -> Column:
        """Best ``struct<vote_count, avg_confidence, rank, type>``; ties go to the earlier method."""
        entries = []
        for i, m in enumerate(self.run):
            mine = {n: self.active(n) & (self.type(n) == self.type(m)) for n in self.run}
            count = sum((F.when(c, 1).otherwise(0) for c in mine.values()), F.lit(0))
            points = tx.total(F.when(c, self.confidence(n)).otherwise(0.0) for n, c in mine.items())
            entries.append(F.when(self.active(m), F.struct(
                count.alias("vote_count"), (points / count).alias("avg_confidence"),
                F.lit(-i).alias("rank"), self.type(m).alias("type"),
            )))
        return F.array_max(F.array(*entries))

    def score(self, m: str) -> Column:
        """Weighted score of the type that ``m`` voted for, NULL when ``m`` did not score."""
        points = tx.total(
            F.when(self.scored(n) & (self.type(n) == self.type(m)),
                   self.confidence(n) * F.lit(self.weights[n])).otherwise(0.0)
            for n in self.weighted
        )
        return F.when(self.scored(m), points)

    def first_of_type(self, m: str) -> Column:
        earlier = self.weighted[:self.weighted.index(m)]
        repeat = tx.any_of([F.lit(False), *(self.scored(n) & (self.type(n) == self.type(m)) for n in earlier)])
        return self.scored(m) & ~repeat

    def top(self, score) -> Column:
        """Type with the highest score; ties go to the type that the weights introduce first."""
        return F.array_max(F.array(*[
            F.when(self.scored(m), F.struct(
                score(m).alias("score"), F.lit(-i).alias("rank"), self.type(m).alias("type")))
            for i, m in enumerate(self.weighted)
        ]))

    def score_list(self) -> Column:
        entries = F.array(*[
            F.when(self.first_of_type(m), F.struct(self.type(m).alias("type"), F.col(f"_w_{m}").alias("score")))
            for m in self.weighted
        ])
        return F.filter(entries, lambda e: e.isNotNull())


def decide(
    docs: DataFrame,
    methods: Sequence[str],
    boosts: DataFrame,
    weights: Mapping[str, float] = rules.WEIGHTS,
) -> DataFrame:
    """Add ``tipo``, ``confidence``, ``consensus`` and ``decision`` to documents with vote columns.

    Works within the row; the only join attaches the supplier boost of the leading type, from
    ``boosts(supplier_id, doc_type, confidence_boost)``.
    """
    v = _Votes(methods, weights)
    kept = list(docs.columns)
    staged = docs.withColumns({
        "_active": v.active_votes(), "_best": v.consensus(), **{f"_w_{m}": v.score(m) for m in v.weighted},
    })
    staged = staged.withColumns({
        "_lead": v.top(lambda m: F.col(f"_w_{m}"))["type"],
        "_scores": v.score_list(),
        "_strong": F.coalesce(
            (F.col("_best.vote_count") >= rules.STRONG_VOTES)
            & (F.col("_best.avg_confidence") >= rules.STRONG_AVERAGE), F.lit(False)),
    })
    staged = staged.join(
        broadcast_if_small(boosts.select(
            F.col("supplier_id").alias("_sid"), F.col("doc_type").alias("_st"), F.col("confidence_boost").alias("_boost")
        )),
        (spread_nulls("supplier_id", "doc_id") == F.col("_sid")) & (F.col("_lead") == F.col("_st")), "left",
    )
    share = F.col("_best.vote_count") / F.size("_active")
    staged = staged.withColumns({
        "_boost": F.when(F.col("_boost") > 0, F.col("_boost")).otherwise(0.0),
        "_factor": F.when(F.col("_strong"), F.lit(rules.CONSENSUS_BOOST) * share).otherwise(0.0),
    })

    def final_score(m: str) -> Column:
        boosted = F.col(f"_w_{m}") + F.when(v.type(m) == F.col("_lead"), F.col("_boost")).otherwise(0.0)
        return boosted + F.when(v.type(m) == F.col("_best.type"), F.col("_factor")).otherwise(0.0)

    staged = staged.withColumn("_final", v.top(final_score))
    best = F.col("_best.type")
    capped = F.least(F.coalesce("_final.score", F.lit(0.0)), F.lit(1.0))
    voted = F.when(~F.col("_strong") & (capped > rules.PENALTY_ABOVE), capped * rules.PENALTY_FACTOR).otherwise(capped)
    priority = {}
    for m, extra in (("agro", rules.AGRO_PRIORITY), ("commercial", rules.COMMERCIAL_PRIORITY)):
        if m in methods:
            sure = F.col(f"{m}.confidence") >= rules.PRIORITY_CONFIDENCE
            priority[m] = (sure, F.least(F.col(f"{m}.confidence") * weights[m] + extra, F.lit(1.0)), extra)
    route = F.lit("vote")
    for m in reversed(list(priority)):
        route = F.when(priority[m][0], m).otherwise(route)
    staged = staged.withColumns({"_route": route, "_voted": voted})

    below = F.col("_voted") < rules.MIN_CONFIDENCE
    tipo = F.when(below, UNKNOWN).otherwise(F.coalesce("_final.type", F.lit(UNKNOWN)))
    confidence = F.when(below, 0.0).otherwise(F.col("_voted"))
    extra_points = F.lit(0.0)
    for m, (_, score, extra) in priority.items():
        is_route = F.col("_route") == m
        tipo = F.when(is_route, F.col(f"{m}.type")).otherwise(tipo)
        confidence = F.when(is_route, score).otherwise(confidence)
        extra_points = F.when(is_route, extra).otherwise(extra_points)
    staged = staged.withColumns({"tipo": tipo, "confidence": confidence, "_extra": extra_points})
    by_vote = F.col("_route") == "vote"
    return staged.select(
        *kept, "tipo", "confidence",
        F.struct(
            best.alias("best_consensus"), F.col("_strong").alias("has_strong_consensus"),
            F.size("_active").alias("total_methods"),
        ).alias("consensus"),
        F.struct(
            F.when(by_vote, F.col("_boost")).otherwise(0.0).alias("supplier_boost"),
            F.when(by_vote, F.col("_factor")).otherwise(0.0).alias("consensus_factor"),
            F.col("_extra").alias("priority_boost"),
            _reason(priority).alias("reasoning"),
        ).alias("decision"),
        F.when(by_vote, F.col("_scores")).otherwise(F.array().cast("array<struct<type:string,score:double>>"))
        .alias("weighted_scores"),
    )


def _reason(priority: Mapping[str, tuple]) -> Column:
    tipo, confidence = F.col("tipo"), F.col("confidence")
    agreeing = F.transform(
        F.filter(F.col("_active"), lambda v: v["type"] == tipo),
        lambda v: F.concat(v["method"], F.lit(" ("), tx.fixed(v["confidence"], 2), F.lit(")")),
    )
    level = (
        F.when(confidence >= rules.HIGH_CONFIDENCE, says.LEVELS[0])
        .when(confidence >= rules.MIN_CONFIDENCE, says.LEVELS[1]).otherwise(says.LEVELS[2])
    )
    text = F.concat_ws(
        " | ",
        F.when(F.size(agreeing) > 0, F.concat(F.lit(says.AGREEING), F.array_join(agreeing, ", "))),
        F.when(F.col("_strong"), F.concat(
            F.lit(says.STRONG[0]), F.col("_best.vote_count").cast("string"), F.lit(says.STRONG[1]))),
        F.when(F.col("supplier_id").isNotNull(), F.concat(F.lit(says.SUPPLIER), F.col("supplier_id"))),
        F.concat(level, F.lit(" ("), tx.fixed(confidence, 3), F.lit(")")),
    )
    text = F.when(F.size("_scores") > 0, text).otherwise("")
    names = says.DOMAIN_NAMES
    for m in priority:
        sentence = F.concat(
            F.lit(f"{says.SHORTCUT[0]}{names[m]}{says.SHORTCUT[1]}"),
            tx.fixed(F.col(f"{m}.confidence"), 3), F.lit(says.SHORTCUT[2]),
        )
        text = F.when(F.col("_route") == m, sentence).otherwise(text)
    return text
