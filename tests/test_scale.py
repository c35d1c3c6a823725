"""Plans and tables whose cost must not grow faster than the rows."""

import re

from pyspark.sql import functions as F

from legajo.functions import bits
from legajo.functions import text as tx
from legajo.operators import bayes, classify, suppliers
from legajo.rules import types


def test_length_of_a_vector_below_the_explode(spark):
    """Computed above it, the length of a document's vector is summed anew for each of its terms."""
    rows = [("a", [("x", 3.0), ("y", 4.0)]), ("b", []), ("b", [("x", 2.0)])]
    weighed = spark.createDataFrame(rows, "label string, _weights array<struct<term:string,w:double>>")
    unit = bayes.unit_terms(weighed)
    assert sorted(map(tuple, unit.collect())) == [("a", "x", 0.6), ("a", "y", 0.8), ("b", "x", 1.0)]
    above, below = unit._jdf.queryExecution().optimizedPlan().toString().split("Generate explode", 1)
    assert "aggregate(" not in above and "aggregate(" in below


def test_masks_in_short_maps(spark):
    """A collected literal is looked up among a few, and finds the bits of itself and of its prefixes."""
    literals = [f"{a}{b}" for a in ("ab", "ábñ", "x y", "it's") for b in ("", *range(60))]
    scan = tx.Scan(literals)
    sizes = [len(re.findall(r"array\(", m)) for m in scan._mask_of("f").split("map(")[1:]]
    assert len(sizes) == tx.MASK_MAPS and max(sizes) < 20
    docs = spark.createDataFrame([("AB7 ab59, it's3",), ("x y12 áBÑ",), ("none",), (None,)], "text string")
    found, t = scan.add_to(docs)
    got = found.select(F.expr(f"filter(array({', '.join(f'CASE WHEN {t.has(x)} THEN {tx.quoted(x)} END' for x in literals)}), x -> x IS NOT NULL)").alias("x"))
    want = [{"ab", "ab7", "ab5", "ab59", "it's", "it's3"}, {"x y", "x y1", "x y12", "ábñ"}, set(), set()]
    assert [set(r.x) for r in got.collect()] == want


def test_a_registry_is_not_gathered_for_a_broadcast(spark):
    """The index of terms joins tables that grow with the registry, each size of gram read from where it was written."""
    terms = spark.range(2000).select(F.format_string("30-%08d-%d", "id", F.col("id") % 10).alias("term"))
    index = suppliers.term_index(terms)
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan and "Aggregate" not in plan.split("Union", 1)[0]
    assert sorted(r.term for r in index.collect()) == sorted(r.term for r in terms.collect())
    large = spark.range(200_000).select(F.col("id").cast("string").alias("term"))
    joined = large.join(suppliers._small_or_merged(large.select("term")), "term")
    assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()


def test_false_hits_stay_few_as_keys_grow(spark):
    """A set of a million bits holds a third of all keys by mistake once 400,000 are in it."""
    keys = 400_000
    words = bits.words_for(keys)
    assert bits.words_for(0) == bits.words_for(1000) == bits.WORDS < words <= bits.MOST_WORDS == bits.words_for(10**9)
    known = spark.range(keys).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    asked = spark.range(2 * keys).select("id", F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), bits.bit_set(known, "key", words).alias("_known"))
    held = asked.filter(bits.may_hold(F.col("_known"), F.col("key"), words)).groupBy((F.col("id") < keys).alias("known")).count()
    counts = {r.known: r["count"] for r in held.collect()}
    assert counts[True] == keys and counts[False] < keys // 50


def test_keyword_tests_are_compiled(spark):
    """Below the higher-order functions that drop what is not found, so generated code makes the tests."""
    texts = ["FACTURA y remito, flete y cereales", "nada", "", None, "credit note / Nota de Crédito"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    done = classify.keyword_details(docs)
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("map_from_arrays(", 1)[1].split("\n", 1)
    assert "CASE WHEN" not in above and below.count("CASE WHEN") > 100
    want = {}
    for i, text in enumerate(texts):
        held = {t: [k for k in ks if k.lower() in (text or "").lower()] for t, ks in types.TYPE_KEYWORDS.items()}
        want[i] = {t: ks for t, ks in held.items() if ks}
    got = {r.doc_id: r.keywords_found for r in done.collect()}
    assert got == want
