"""Naive Bayes over TF-IDF with sparse vectors in the row.

A document's terms and their counts are one array, so lengths, weights and class scores are sums within the row. Only
counts per term and sums per (label, term) are shuffled, after partial aggregation. The vocabulary is bounded by its
term limit, and so is the model (terms times labels), which is why both are constants of a plan: hash tables held as
arrays, in which a term is found by its bucket.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from legajo.functions import text as tx
from legajo.rules import training as rules
from legajo.session import stage


#: Hexadecimal digits of the id's hash that make a slot of the split: a million slots.
SLOT_DIGITS = 5


class BayesModel(NamedTuple):
    """``terms(term, idf, label, log_prob)`` and ``priors(label, log_prior)``."""

    terms: DataFrame
    priors: DataFrame


def built_in_samples(spark: SparkSession) -> DataFrame:
    rows = [(i, text, label) for i, (label, text) in enumerate(rules.SAMPLES)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, label string")


def terms(text: Column) -> Column:
    """Words of two characters or more without stop words, and their neighbouring pairs."""
    words = F.regexp_extract_all(F.lower(tx.text_or_empty(text)), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(*dict.fromkeys(rules.STOP_WORDS)))

    def with_pairs(w: Column) -> Column:
        later = F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0)))
        pairs = F.zip_with(F.slice(w, 1, F.size(later)), later, lambda a, b: F.concat_ws(" ", a, b))
        return F.concat(w, pairs)

    return tx.let(kept, with_pairs)


def counted(values: Column) -> Column:
    """The distinct values of an array, in order, with how often each occurs: ``array<struct<value, n>>``."""

    def runs(a: Column) -> Column:
        last = F.filter(F.sequence(F.lit(1), F.size(a)), lambda i: (i == F.size(a)) | (F.get(a, i - 1) != F.get(a, i)))
        return tx.let(last, lambda ends: F.transform(ends, lambda e, k: F.struct(
            F.get(a, e - 1).alias("value"), (e - F.when(k == 0, 0).otherwise(F.get(ends, k - 1))).alias("n"))))

    return tx.let(F.sort_array(values), lambda a: F.when(F.size(a) > 0, runs(a)).otherwise(F.filter(runs(F.array_repeat(F.get(a, 0), 1)), lambda x: F.lit(False))))


def term_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, term, n`` for a table with ``doc_id, text``."""
    return docs.select("doc_id", F.explode(counted(terms(F.col("text")))).alias("c")).select("doc_id", F.col("c.value").alias("term"), "c.n")


def vocabulary(counts: DataFrame, docs: DataFrame, max_terms: int = rules.MAX_TERMS) -> DataFrame:
    """``term, idf`` of the terms kept: enough documents, not too common, most frequent first."""
    size = docs.agg(F.count("*")).scalar()
    stats = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("tf"))
    chosen = (
        stats.withColumn("_docs", size)
        .filter((F.col("df") >= rules.MIN_DOCUMENTS) & (F.col("df") <= F.lit(rules.MAX_SHARE) * F.col("_docs")))
        .orderBy(F.desc("tf"), "term").limit(max_terms)
    )
    return chosen.select("term", (F.log((F.lit(1.0) + F.col("_docs")) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf"))


#: Buckets of a vocabulary's hash table for each term that it may hold.
BUCKETS_PER_TERM = 2


class Lookup(NamedTuple):
    """A vocabulary as two constants: ``buckets``, an array of buckets of ``struct<term, id>``, and ``entries``, an
    array of what is known of each term, by id."""

    buckets: Column
    entries: Column
    size: int

    def id_of(self, buckets: Column, term: Column) -> Column:
        """The id of ``term``, null if it is not in the vocabulary."""
        bucket = F.get(buckets, F.pmod(F.xxhash64(term), F.lit(self.size)).cast("int"))
        return F.get(F.filter(bucket, lambda e: e["term"] == term), 0)["id"]


def lookup(entries: DataFrame, max_terms: int) -> Lookup:
    """``entries``: a row per term, ``term`` and other columns; ids follow the terms' order. Scalar subqueries, to be
    columns before they are used in higher-order functions."""
    row = F.struct("term", *[c for c in entries.columns if c != "term"])
    ordered = entries.agg(F.array_sort(F.collect_list(row)).alias("all"))
    size = BUCKETS_PER_TERM * max_terms
    placed = ordered.select(F.posexplode("all").alias("id", "e")).select("id", F.col("e.term").alias("term"))
    filled = placed.groupBy(F.pmod(F.xxhash64("term"), F.lit(size)).alias("bucket")).agg(F.collect_list(F.struct("term", "id")).alias("held"))
    every = entries.sparkSession.range(size).withColumnRenamed("id", "bucket").join(filled, "bucket", "left")
    buckets = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "held"))), lambda x: x["held"]))
    return Lookup(buckets.scalar(), ordered.scalar(), size)


def training_part(samples: DataFrame) -> DataFrame:
    """The samples a model is fitted on: those outside the test split, or all where there is none."""
    return _part(samples, ~F.coalesce("is_test", F.lit(False)))


def test_part(samples: DataFrame) -> DataFrame:
    """The samples a model is scored on: the test split, or all where there is none."""
    return _part(samples, F.coalesce("is_test", F.lit(True)))


def _part(samples: DataFrame, condition: Column) -> DataFrame:
    """Samples that already carry ``is_test`` are only filtered."""
    if "is_test" in samples.columns:
        return samples.filter(condition).drop("is_test")
    flags = split(samples.select("doc_id", "label")).filter(condition)
    return samples.join(flags.select("doc_id", "label").distinct(), ["doc_id", "label"], "left_semi")


def unit_terms(weighed: DataFrame) -> DataFrame:
    """``label, term, w`` of ``weighed(label, _weights)``, the weights of a row divided by their length.

    The length is a column of its own below the explode: beside it, it would be computed again for every term of a row,
    each time from all of them, and every term's row would carry all weights."""
    square = F.aggregate("_weights", F.lit(0.0), lambda s, x: s + x["w"] * x["w"])
    normed = weighed.withColumn("_norm", F.sqrt(square))
    unit = normed.select("label", "_norm", F.explode("_weights").alias("x"))
    return unit.select("label", F.col("x.term").alias("term"), (F.col("x.w") / F.col("_norm")).alias("w"))


def train(samples: DataFrame, max_terms: int = rules.MAX_TERMS) -> BayesModel:
    """Model of ``samples(doc_id, text, label)``, fitted on their training part."""
    samples = training_part(samples)
    vectors = stage(samples.select("label", counted(terms(F.col("text"))).alias("vector")), "term-vectors")
    counts = vectors.select(F.explode("vector").alias("c")).select(F.col("c.value").alias("term"), "c.n")
    idf = stage(vocabulary(counts, vectors, max_terms), "vocabulary")
    known = lookup(idf, max_terms)
    held = vectors.withColumns({"_buckets": known.buckets, "_entries": known.entries})
    weights = F.array_compact(F.transform("vector", lambda x: tx.let(known.id_of(F.col("_buckets"), x["value"]), lambda i: F.when(
        i.isNotNull(), F.struct(x["value"].alias("term"), (x["n"] * F.get("_entries", i)["idf"]).alias("w"))))))
    weighed = unit_terms(held.select("label", weights.alias("_weights")))
    sums = weighed.groupBy("label", "term").agg(F.sum("w").alias("s"))
    per_label = vectors.groupBy("label").agg(F.count("*").alias("n"))
    # Every label needs a probability for every kept term; both are bounded.
    names = per_label.agg(F.array_sort(F.collect_list("label"))).scalar()
    grid = idf.withColumn("_labels", names).select("term", "idf", F.explode("_labels").alias("label"))
    smoothed = grid.join(sums, ["label", "term"], "left").select(
        "label", "term", "idf", (F.coalesce("s", F.lit(0.0)) + rules.ALPHA).alias("s")
    )
    totals = smoothed.groupBy("label").agg(F.sum("s").alias("total"))
    model = smoothed.join(F.broadcast(totals), "label").select(
        "term", "idf", "label", (F.log("s") - F.log("total")).alias("log_prob")
    )
    everything = per_label.agg(F.sum("n").cast("double")).scalar()
    priors = per_label.select(
        "label", (F.log(F.col("n").cast("double")) - F.log(everything)).alias("log_prior")
    )
    return BayesModel(model, priors)


def save_model(model: BayesModel, path: str) -> None:
    model.terms.write.mode("errorifexists").parquet(f"{path}/terms")
    model.priors.write.mode("errorifexists").parquet(f"{path}/priors")


def load_model(spark: SparkSession, path: str) -> BayesModel:
    return BayesModel(spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/priors"))


def _scored(docs: DataFrame, model: BayesModel) -> DataFrame:
    """``doc_id, labels, chances``: the model's labels in order and the document's probability of each, in arrays.

    A document without a known term gets the class priors. Nothing of the documents is shuffled.
    """
    per_term = model.terms.groupBy("term").agg(
        F.first("idf").alias("idf"), F.transform(F.array_sort(F.collect_list(F.struct("label", "log_prob"))), lambda x: x["log_prob"]).alias("lp"))
    known = lookup(per_term, rules.MAX_TERMS)
    priors = model.priors.agg(F.array_sort(F.collect_list(F.struct("label", "log_prior")))).scalar()
    held = docs.select("doc_id", "text", known.buckets.alias("_buckets"), known.entries.alias("_entries"), priors.alias("_priors"))
    ids = F.array_compact(F.transform(terms(F.col("text")), lambda t: known.id_of(F.col("_buckets"), t)))
    weights = F.transform(counted(ids), lambda x: tx.let(F.get("_entries", x["value"]), lambda e: F.struct((x["n"] * e["idf"]).alias("w"), e["lp"].alias("lp"))))
    weighed = held.select("doc_id", "_priors", weights.alias("_w"))
    norm = F.sqrt(F.aggregate("_w", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
    none = F.transform("_priors", lambda p: F.lit(0.0))
    sums = F.aggregate("_w", none, lambda s, x: F.zip_with(s, x["lp"], lambda a, b: a + x["w"] * b))
    score = F.zip_with(F.col("_priors"), sums, lambda p, s: p["log_prior"] + F.when(F.col("_norm") > 0, s / F.col("_norm")).otherwise(0.0))
    scored = weighed.withColumn("_norm", norm).select("doc_id", F.transform("_priors", lambda p: p["label"]).alias("labels"), score.alias("_s"))
    relative = tx.let(F.array_max("_s"), lambda top: F.transform("_s", lambda s: F.exp(s - top)))
    scored = scored.select("doc_id", "labels", relative.alias("_e"))
    whole = F.aggregate("_e", F.lit(0.0), lambda s, x: s + x)
    return scored.select("doc_id", "labels", tx.let(whole, lambda t: F.transform("_e", lambda e: e / t)).alias("chances"))


def probabilities(docs: DataFrame, model: BayesModel) -> DataFrame:
    """``doc_id, label, probability`` for every document and label."""
    long = _scored(docs, model).select("doc_id", F.explode(F.arrays_zip("labels", "chances")).alias("x"))
    return long.select("doc_id", F.col("x.labels").alias("label"), F.col("x.chances").alias("probability"))


def predict(docs: DataFrame, model: BayesModel) -> DataFrame:
    """``doc_id, type, confidence``: the likeliest label, of equal ones the first by name."""
    top = F.array_max("chances")
    best = F.get("labels", (F.array_position("chances", top) - 1).cast("int"))
    return _scored(docs, model).select("doc_id", best.alias("type"), top.alias("confidence"))


def probability_map(docs: DataFrame, model: BayesModel) -> DataFrame:
    """``doc_id, probabilities`` with one map per document."""
    return _scored(docs, model).select("doc_id", F.map_from_arrays("labels", "chances").alias("probabilities"))


def top_terms(model: BayesModel, k: int = 20) -> DataFrame:
    """The ``k`` terms with the highest log-probability per label."""
    order = Window.partitionBy("label").orderBy(F.desc("log_prob"), "term")
    ranked = model.terms.withColumn("position", F.row_number().over(order))
    return ranked.filter(F.col("position") <= k).select("label", "term", "log_prob", "position")


def class_counts(samples: DataFrame, minimum: int = rules.MIN_SAMPLES_PER_CLASS) -> DataFrame:
    """Samples per label, and whether there are too few."""
    counts = samples.groupBy("label").agg(F.count("*").alias("n"))
    return counts.withColumn("too_few", F.col("n") < minimum)


def split(samples: DataFrame, share: float = rules.TEST_SHARE, seed: int = rules.SPLIT_SEED) -> DataFrame:
    """``samples(doc_id, label, ...)`` with ``is_test`` for a stratified split that depends only on the ids.

    Per label the first ``share`` by a hash of the id is the test part. The hash's first digits make slots, which
    are counted; all but one slot per label fall on one side as a whole, so only that slot's rows are ranked.
    With fewer than 20 samples there is no split and ``is_test`` is NULL.
    """
    digest = F.md5(F.concat_ws("-", F.col("doc_id").cast("string"), F.lit(str(seed))))
    keyed = samples.withColumn("_h", digest).withColumn("_slot", F.substring("_h", 1, SLOT_DIGITS))
    slots = keyed.groupBy("label", "_slot").agg(F.count("*").alias("_n"))
    by_label = Window.partitionBy("label")
    before = F.sum("_n").over(by_label.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))
    plan = slots.select(
        "label", "_slot", "_n", F.coalesce(before, F.lit(0)).alias("_before"),
        F.round(F.sum("_n").over(by_label) * share).alias("_wanted"),
    )
    everything = samples.agg(F.count("*")).scalar()
    placed = keyed.join(plan, ["label", "_slot"])
    full, none = F.col("_before") + F.col("_n") <= F.col("_wanted"), F.col("_before") >= F.col("_wanted")
    whole = placed.filter(full | none).withColumn("_test", full)
    order = Window.partitionBy("label", "_slot").orderBy("_h", "doc_id")
    edge = placed.filter(~full & ~none).withColumn(
        "_test", F.col("_before") + F.row_number().over(order) <= F.col("_wanted")
    )
    return whole.unionByName(edge).withColumn("_all", everything).select(
        *samples.columns, F.when(F.col("_all") >= rules.SPLIT_FROM, F.col("_test")).alias("is_test")
    )


def accuracy(predicted: DataFrame, samples: DataFrame) -> DataFrame:
    """Share of samples whose prediction equals the label; pass ``test_part`` for rows the model has not seen."""
    hits = samples.join(predicted, "doc_id").select((F.col("type") == F.col("label")).cast("double").alias("hit"))
    return hits.agg(F.count("*").alias("samples"), F.avg("hit").alias("accuracy"))


def with_feedback(samples: DataFrame, overrides: DataFrame, catalog: DataFrame) -> DataFrame:
    """Training samples plus the reviewed documents with their corrected type."""
    reviewed = overrides.join(catalog.select(F.col("id").alias("doc_id"), "texto_extraido"), "doc_id").select(
        "doc_id", F.col("texto_extraido").alias("text"), F.col("tipo").alias("label")
    )
    return samples.unionByName(reviewed)
