"""Supplier detection, lookups, search and registry edits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from legajo.functions import text as tx
from legajo.functions.bits import bit_set, may_hold, words_for
from legajo.rules import suppliers as rules
from legajo.session import broadcast_if_small, spread_nulls, stage
from legajo.sources.registry import registry_patterns

#: Characters of the grams by which texts find a term, the next size where a term's rarest gram is still too frequent.
#: A term shorter than the first size is found by all of its characters.
GRAMS = (4, 8, 16)
#: Terms that may share a gram before they are filed under a longer one.
POSTING = 16


def _partial_words(name: str) -> list[str]:
    words = name.upper().split()
    return words if len(name) > rules.PARTIAL_NAME_LENGTH and len(words) >= 2 else []


def _literals(rows: Sequence[Row]) -> set[str]:
    found: set[str] = set()
    for row in rows:
        for name in row.names or []:
            found.update([name.upper(), *_partial_words(name)])
        found.update(x for x in [row.cuit] if x)
        for p in (row.document_patterns or {}).values():
            found.update(x.upper() for x in [*(p.specific_terms or []), *(p.layout_indicators or [])])
    return found


def _share(t: tx.ScannedText, terms: Sequence[str] | None, points: float) -> str:
    if not terms:
        return "0.0D"
    hits = " + ".join(f"CAST({t.has(x.upper())} AS INT)" for x in terms)
    return f"(({hits}) / {tx.number(len(terms))}) * {tx.number(points)}"


def _score(t: tx.ScannedText, row: Row) -> str:
    partial = [
        "(" + " + ".join(f"CAST({t.has(w)} AS INT)" for w in words) + ") >= 2"
        for words in map(_partial_words, row.names or []) if words
    ]
    name = "0.0D"
    if row.names:
        name = (
            f"CASE WHEN {t.has_any([n.upper() for n in row.names])} THEN {tx.number(rules.POINTS_NAME)} "
            f"WHEN {tx.one_of(partial)} THEN {tx.number(rules.POINTS_PARTIAL_NAME)} ELSE 0.0D END"
        )
    tax = tx.points_if(t.has(row.cuit), rules.POINTS_TAX_ID) if row.cuit else "0.0D"
    by_type = [
        f"{_share(t, p.specific_terms, rules.POINTS_TERMS)} + {_share(t, p.layout_indicators, rules.POINTS_INDICATORS)}"
        for p in (row.document_patterns or {}).values()
    ]
    pattern = f"greatest(0.0D, {', '.join(by_type)})" if by_type else "0.0D"
    return f"least({name} + {tax} + {pattern}, 1.0D)"


def detect_supplier(docs: DataFrame, registry: DataFrame | Sequence[Row], threshold: float = rules.SUPPLIER_THRESHOLD) -> DataFrame:
    """Add ``supplier_id`` (NULL when no supplier is sure enough) and ``supplier_confidence``.

    A registry of constants (rows) is compiled into columns and needs no shuffle; a table of any size is joined
    by the terms that occur, for ``docs`` with a unique ``doc_id``.
    """
    if isinstance(registry, DataFrame):
        top = _best_by_join(docs, registry).withColumnRenamed("doc_id", "_doc")
        chosen = docs.join(top, F.col("doc_id") == F.col("_doc"), "left").drop("_doc")
    else:
        chosen = _best_by_columns(docs, list(registry))
    sure = F.coalesce(F.col("_top.score") >= threshold, F.lit(False))
    return chosen.withColumns({
        "supplier_id": F.when(sure, F.col("_top.id")),
        "supplier_confidence": F.when(sure, F.col("_top.score")).otherwise(0.0),
    }).drop("_top")


def _best_by_columns(docs: DataFrame, rows: Sequence[Row]) -> DataFrame:
    """``docs`` with ``_top``, the best ``struct<score, rank, id>``."""
    if not rows:
        return docs.withColumn("_top", F.lit(None).cast("struct<score:double,rank:int,id:string>"))
    scanned, t = tx.Scan(_literals(rows), upper=True).add_to(docs)
    entries = ", ".join(
        f"named_struct('score', {_score(t, r)}, 'rank', {-r.ord}, 'id', {tx.quoted(r.supplier_id)})" for r in rows
    )
    best = F.expr(f"CASE WHEN {t.may_score()} THEN array_max(array({entries})) END")
    return scanned.select(*docs.columns, best.alias("_top"))


def registry_terms(registry: DataFrame) -> DataFrame:
    """``term, supplier_id, ord, kind, part, size`` of each supplier: whole names, words of long names (by name),
    tax id, and terms and indicators of each document type with how many there are."""
    u = F.upper
    base = registry.select("supplier_id", "ord", "names", "cuit", "document_patterns")
    none = F.array().cast("array<string>")

    def entry(term: Column, kind: str, part: Column, size: Column) -> Column:
        return F.struct(term.alias("term"), F.lit(kind).alias("kind"), part.cast("string").alias("part"), size.alias("size"))

    one = F.lit(1)
    names = F.coalesce("names", none)
    long = F.filter(names, lambda n: (F.char_length(n) > rules.PARTIAL_NAME_LENGTH) & (F.size(_words(n)) >= 2))
    words = F.flatten(F.transform(long, lambda n: F.transform(_words(n), lambda w: entry(w, "word", n, one))))
    types = F.map_entries(F.coalesce("document_patterns", F.create_map().cast("map<string,struct<specific_terms:array<string>,layout_indicators:array<string>,confidence_boost:double>>")))

    def of(kind: str, field: str) -> Column:
        return F.flatten(F.transform(types, lambda p: F.transform(
            F.coalesce(p["value"][field], none), lambda x: entry(u(x), kind, p["key"], F.size(p["value"][field])))))

    every = F.concat(
        F.transform(names, lambda n: entry(u(n), "name", one, one)), words,
        F.transform(F.array_compact(F.array("cuit")), lambda c: entry(c, "tax", one, one)),
        of("term", "specific_terms"), of("indicator", "layout_indicators"),
    )
    return base.select("supplier_id", "ord", F.explode(every).alias("e")).select("supplier_id", "ord", "e.*").filter(F.col("term") != "")


def _words(name: Column) -> Column:
    return F.filter(F.split(F.upper(name), r"(?U)\s+"), lambda w: w != "")


def _grams(text: Column, size: int) -> Column:
    """The stretch of ``size`` characters at every position but the last few, in one pass (by a look-ahead)."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def term_index(terms: DataFrame) -> DataFrame:
    """``gram, size, term``: each distinct term under the rarest of its grams (ties by the gram).

    Grams are counted over all terms. A term whose rarest gram more than ``POSTING`` terms share is filed anew by a
    longer one, so terms that begin alike, or share any stretch, still spread over many postings. Each size is written
    once and read by the next; the tables grow with the registry, so none is gathered for a broadcast.
    """
    left = terms.select("term").distinct().withColumn("_n", F.char_length("term"))
    short = left.filter(F.col("_n") < GRAMS[0]).select(F.col("term").alias("gram"), F.col("_n").alias("size"), "term")
    filed, left = [short], left.filter(F.col("_n") >= GRAMS[0])
    for size, longer in zip(GRAMS, (*GRAMS[1:], None), strict=True):
        held = left.select("term", "_n", F.explode(F.array_distinct(_grams(F.col("term"), size))).alias("gram"))
        counts = held.groupBy("gram").agg(F.count("*").alias("_terms"))
        rarest = stage(held.join(counts.hint("merge"), "gram").groupBy("term", "_n").agg(F.min(F.struct("_terms", "gram")).alias("_r")), f"grams-{size}")
        again = F.lit(False) if longer is None else (F.col("_r._terms") > POSTING) & (F.col("_n") >= longer)
        filed.append(rarest.filter(~again).select(F.col("_r.gram").alias("gram"), F.lit(size).alias("size"), "term"))
        left = rarest.filter(again).select("term", "_n")
    index = filed[0]
    for f in filed[1:]:
        index = index.unionByName(f)
    return index


def term_candidates(docs: DataFrame, index: DataFrame) -> DataFrame:
    """``doc_id, term, around``: terms whose gram stands in a text, with the stretch of text around it that holds the
    term if the term is there. A document meets the postings of its own grams only.

    Grams that no term is filed under are dropped in the row, by a set of bits for each size; what is shuffled are the others. The
    text itself is not: a stretch of the longest term's length on both sides decides.
    """
    # a row for each size in use
    sizes = index.groupBy("size").agg(F.count("*").alias("n"), F.max(F.char_length("term")).alias("longest")).orderBy("size").collect()
    longest = max((r["longest"] for r in sizes), default=0)
    text = docs.select("doc_id", F.upper(tx.text_or_empty(F.col("text"))).alias("_text"))
    found = None
    for size, keys in ((r["size"], r["n"]) for r in sizes):
        words = words_for(keys)
        lean = text.withColumn("_known", bit_set(index.filter(F.col("size") == size), "gram", words))
        held = lean.withColumn("_g", _grams(F.col("_text"), size)).filter(F.size("_g") > 0)
        places = F.filter(F.sequence(F.lit(0), F.size("_g") - 1), lambda i: may_hold(F.col("_known"), F.get("_g", i), words))  # noqa: B023
        # places count characters, but for texts with characters beyond the basic plane, which are looked at whole
        plain = F.size("_g") == F.char_length("_text") - (size - 1)
        start = lambda i: F.greatest(i + 1 - longest, F.lit(1))
        around = F.explode(F.array_distinct(F.transform(places, lambda i: F.struct(
            F.get("_g", i).alias("gram"), F.when(plain, F.substring(F.col("_text"), start(i), F.lit(2 * longest))).otherwise(F.col("_text")).alias("around"),
        ))))
        rows = held.select("doc_id", around.alias("x")).select("doc_id", "x.gram", "x.around")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return docs.select("doc_id", F.lit("").alias("term"), F.lit("").alias("around")).filter(F.lit(False))
    return found.join(_small_or_merged(index.select("gram", "term")), "gram").select("doc_id", "term", "around")


def _small_or_merged(table: DataFrame) -> DataFrame:
    """Marked for broadcast after counting, or for a merge: the bytes of a registry's files say little of its rows, so a
    large one would be gathered by its size."""
    small = broadcast_if_small(table)
    return table.hint("merge") if small is table else small


def _best_by_join(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """``doc_id, _top`` for documents in which any term of the registry occurs.

    Texts meet terms by an index of rarest grams; terms found are tested against the text around, and only those that
    occur meet their suppliers. Of the registry sets of bits of bounded size go to the tasks. Its terms and their index
    are written once, as each is read several times.
    """
    terms = stage(registry_terms(registry), "registry-terms")
    index = stage(term_index(terms), "term-index")
    hits = term_candidates(docs, index).filter(F.contains("around", F.col("term"))).select("doc_id", "term").distinct()
    found = hits.join(_small_or_merged(terms), "term").groupBy("doc_id", "supplier_id", "ord", "kind", "part").agg(
        F.count("*").alias("n"), F.max("size").alias("size")
    )
    is_kind = lambda k: F.col("kind") == k
    share = F.col("n") / F.col("size").cast("double")
    by_type = found.groupBy("doc_id", "supplier_id", "ord", F.when(is_kind("term") | is_kind("indicator"), F.col("part")).alias("type")).agg(
        F.max(is_kind("name").cast("int")).alias("name"), F.max((is_kind("word") & (F.col("n") >= 2)).cast("int")).alias("partial"),
        F.max(is_kind("tax").cast("int")).alias("tax"),
        F.sum(F.when(is_kind("term"), share * rules.POINTS_TERMS).otherwise(0.0)).alias("terms"),
        F.sum(F.when(is_kind("indicator"), share * rules.POINTS_INDICATORS).otherwise(0.0)).alias("indicators"),
    )
    name = F.when(F.max("name") > 0, rules.POINTS_NAME).when(F.max("partial") > 0, rules.POINTS_PARTIAL_NAME).otherwise(0.0)
    score = F.least(
        name + F.when(F.max("tax") > 0, rules.POINTS_TAX_ID).otherwise(0.0) + F.max(F.col("terms") + F.col("indicators")), F.lit(1.0)
    )
    scored = by_type.groupBy("doc_id", "supplier_id", "ord").agg(score.alias("score"))
    return scored.groupBy("doc_id").agg(
        F.max(F.struct("score", (-F.col("ord")).alias("rank"), F.col("supplier_id").alias("id"))).alias("_top")
    )


def supplier_lookup(docs: DataFrame, registry: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Registry entry of each document's supplier; NULL when it has none."""
    entries = registry.drop("ord").withColumnRenamed("supplier_id", "_sid")
    return docs.join(broadcast_if_small(entries), spread_nulls("supplier_id", id_column) == F.col("_sid"), "left").drop("_sid")


def supplier_boost(docs: DataFrame, registry: DataFrame, type_column: str = "doc_type", id_column: str = "doc_id") -> DataFrame:
    """Add ``supplier_boost`` for the document's supplier and type; 0 without an entry."""
    boosts = registry_patterns(registry).select(
        F.col("supplier_id").alias("_sid"), F.col("doc_type").alias("_type"), F.col("confidence_boost").alias("_boost")
    )
    same = (spread_nulls("supplier_id", id_column) == F.col("_sid")) & (F.col(type_column) == F.col("_type"))
    joined = docs.join(broadcast_if_small(boosts), same, "left")
    return joined.withColumn("supplier_boost", F.coalesce("_boost", F.lit(0.0))).drop("_sid", "_type", "_boost")


def search_suppliers(registry: DataFrame, query: str) -> DataFrame:
    """Suppliers whose name or tax id contains the query; tax-id hits first."""
    q = F.lit(query.upper())
    by_name = F.exists("names", lambda n: F.contains(F.upper(n), q))
    by_tax = F.contains(F.coalesce("cuit", F.lit("")), q)
    return (
        registry.filter(by_name | by_tax)
        .withColumn("match_score", F.when(by_tax, 1.0).otherwise(0.8))
        .orderBy(F.desc("match_score"), "ord")
    )


def upsert(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of ``changes`` replace those with the same key; new keys are added."""
    return current.join(changes, key, "left_anti").unionByName(changes, allowMissingColumns=True)


def update_existing(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of ``changes`` replace those with the same key; unknown keys are ignored."""
    known = changes.join(current.select(key), key, "left_semi")
    return upsert(current, known, key)


def _merge_terms(old: Column, new: Column) -> Column:
    """Append new terms that differ from the old ones in more than letter case."""
    seen = F.transform(old, lambda x: F.upper(x))
    return F.concat(old, F.filter(new, lambda x: ~F.array_contains(seen, F.upper(x))))


def merge_patterns(patterns: DataFrame, additions: DataFrame, known_ids: DataFrame) -> DataFrame:
    """Merge ``additions(supplier_id, doc_type, new_terms, new_indicators)`` into flat patterns; a new
    type of a known supplier starts with a small boost, unknown suppliers are ignored."""
    none = F.array().cast("array<string>")
    valid = additions.join(known_ids.select("supplier_id"), "supplier_id", "left_semi")
    joined = patterns.join(valid, ["supplier_id", "doc_type"], "full")
    return joined.select(
        "supplier_id", "doc_type",
        _merge_terms(F.coalesce("specific_terms", none), F.coalesce("new_terms", none)).alias("specific_terms"),
        _merge_terms(F.coalesce("layout_indicators", none), F.coalesce("new_indicators", none))
        .alias("layout_indicators"),
        F.coalesce("confidence_boost", F.lit(rules.NEW_PATTERN_BOOST)).alias("confidence_boost"),
    )
