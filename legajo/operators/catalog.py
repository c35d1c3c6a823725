"""The document catalog: build, search, page, statistics, file routing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from legajo.functions import metadata as md
from legajo.functions import text as tx
from legajo.functions.bits import bit_set, may_hold
from legajo.operators import consensus
from legajo.operators.classify import RULE_METHODS, rule_votes
from legajo.operators.suppliers import detect_supplier
from legajo.rules import catalog as rules
from legajo.rules import ensemble
from legajo.rules.types import UNKNOWN
from legajo.sources.registry import built_in_registry, built_in_rows, registry_patterns

DETAILS = (
    "struct<method_results:map<string,struct<type:string,confidence:double>>,"
    "decision:struct<supplier_boost:double,consensus_factor:double,priority_boost:double,reasoning:string>,"
    "consensus:struct<best_consensus:string,has_strong_consensus:boolean,total_methods:int>>"
)
SCHEMA = (
    "id bigint, filename string, cuit string, proveedor string, proveedor_id string, "
    "fecha_documento string, monto string, confidence double, fecha_procesado timestamp_ntz, "
    f"detalles_clasificacion {DETAILS}, metodos_usados array<string>, texto_extraido string, "
    "doc_date date, amount decimal(18,2), tipo string"
)


# ---------------------------------------------------------------- build


def classify(
    docs: DataFrame, registry: DataFrame | None = None, methods: Sequence[str] = RULE_METHODS,
    extra_votes: Mapping[str, DataFrame] | None = None,
    weights: Mapping[str, float] = ensemble.WEIGHTS,
) -> DataFrame:
    """Vote columns, supplier, final type and confidence for ``docs(doc_id, text, ...)``.

    ``extra_votes`` adds methods computed elsewhere as ``doc_id, type, confidence`` (Naive Bayes,
    layout, or any user-defined scorer); they join without the text and vote like the built-in ones.
    Every method needs an entry in ``weights``. ``registry``: a table, joined; without one the built-in
    suppliers, compiled into the plan.
    """
    voted = detect_supplier(rule_votes(docs, methods), built_in_rows() if registry is None else registry)
    registry = built_in_registry(docs.sparkSession) if registry is None else registry
    names = list(methods)
    for name, votes in (extra_votes or {}).items():
        vote = votes.select("doc_id", F.struct(F.col("type"), F.col("confidence").cast("double").alias("confidence")).alias(name))
        voted = voted.join(vote, "doc_id", "left").withColumn(
            name, F.coalesce(name, F.struct(F.lit(UNKNOWN).alias("type"), F.lit(0.0).alias("confidence")))
        )
        names.append(name)
    decided = consensus.decide(voted, names, registry_patterns(registry), weights)
    used = F.array(*[F.lit(m) for m in ensemble.run_order(names)])
    return decided.withColumn("methods_used", used)


def vote_columns(classified: DataFrame) -> list[str]:
    """Methods that voted on these documents, by their ``struct<type, confidence>`` columns, in run order."""
    shape = [("type", "string"), ("confidence", "double")]
    return ensemble.run_order([
        f.name for f in classified.schema
        if isinstance(f.dataType, StructType) and [(x.name, x.dataType.simpleString()) for x in f.dataType] == shape
    ])


def catalog_rows(classified: DataFrame, methods: Sequence[str] | None = None) -> DataFrame:
    """Catalog rows of classified documents: first date and first amount, details kept typed.

    The details hold the votes of all methods that took part, unless ``methods`` names some."""
    methods = vote_columns(classified) if methods is None else methods
    text = tx.text_or_empty(F.col("text"))
    meta = classified.withColumns({
        "_dates": md.dates(text), "_amounts": md.amounts(text), "cuit": md.tax_id(text),
        "proveedor": md.supplier_name(text),
    })
    results = F.create_map(*[x for m in methods for x in (F.lit(m), F.col(m))])
    flat = meta.select(
        F.col("doc_id").alias("id"), "filename", "tipo", "cuit", "proveedor",
        F.col("supplier_id").alias("proveedor_id"),
        F.try_element_at("_dates", F.lit(1)).alias("fecha_documento"),
        F.try_element_at("_amounts", F.lit(1)).alias("monto"), "confidence",
        F.col("processed_at").alias("fecha_procesado"),
        F.struct(results.alias("method_results"), "decision", "consensus").alias("detalles_clasificacion"),
        F.col("methods_used").alias("metodos_usados"), F.col("text").alias("texto_extraido"),
    )
    return flat.withColumns({
        "doc_date": md.parsed_date(F.col("fecha_documento")), "amount": md.normalized_amount(F.col("monto")),
    })


def create_catalog(spark: SparkSession, name: str, path: str) -> None:
    """Create the catalog table if it does not exist."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({SCHEMA}) USING parquet PARTITIONED BY (tipo) LOCATION '{path}'")


def append_catalog(rows: DataFrame, path: str) -> None:
    """Append rows, in folders by type. Rebalancing makes few, even files and splits a type that holds
    a large share of the rows over several tasks."""
    rows.hint("rebalance", "tipo").write.mode("append").partitionBy("tipo").parquet(path)


def merge_tables(current: DataFrame, other: DataFrame) -> DataFrame:
    """All rows of both, columns matched by name; columns missing on one side become NULL."""
    return current.unionByName(other, allowMissingColumns=True)


# ---------------------------------------------------------------- search


def search_filter(
    *, cuit: str | None = None, proveedor: str | None = None, tipo: str | None = None,
    fecha_desde: str | None = None, fecha_hasta: str | None = None, confidence_min: float | None = None,
    monto_min: float | None = None, monto_max: float | None = None, amounts: str = "normalized",
) -> Column:
    """Conjunction of the given filters. Dates are ISO and compared as dates; ``amounts`` is ``strict``
    (plain replacement of separators) or ``normalized``."""
    tests: list[Column] = []
    if cuit:
        tests.append(F.col("cuit").like(f"%{cuit}%"))
    if proveedor:
        tests.append(F.col("proveedor").like(f"%{proveedor}%"))
    if tipo:
        tests.append(F.col("tipo") == tipo)
    if fecha_desde:
        tests.append(F.col("doc_date") >= F.lit(fecha_desde).cast("date"))
    if fecha_hasta:
        tests.append(F.col("doc_date") <= F.lit(fecha_hasta).cast("date"))
    if confidence_min is not None:
        tests.append(F.col("confidence") >= confidence_min)
    value = F.col("amount") if amounts == "normalized" else md.strict_amount(F.col("monto"))
    if monto_min is not None:
        tests.append(value >= F.lit(str(monto_min)).cast("decimal(18,2)"))
    if monto_max is not None:
        tests.append(value <= F.lit(str(monto_max)).cast("decimal(18,2)"))
    return _all(tests)


def cli_filter(cuit: str | None = None, proveedor: str | None = None, tipo: str | None = None) -> Column:
    """Exact tax id, part of the supplier name, exact type."""
    tests = [F.col("cuit") == cuit] if cuit else []
    tests += [F.col("proveedor").like(f"%{proveedor}%")] if proveedor else []
    tests += [F.col("tipo") == tipo] if tipo else []
    return _all(tests)


def export_filter(filters: Mapping[str, object] | None = None) -> Column:
    """Filters of an export; empty or zero values mean no filter."""
    f = filters or {}
    tests = []
    if f.get("document_type"):
        tests.append(F.col("tipo") == f["document_type"])
    if f.get("min_confidence"):
        tests.append(F.col("confidence") >= f["min_confidence"])
    if f.get("date_from"):
        tests.append(F.col("fecha_procesado") >= F.lit(f["date_from"]).cast("timestamp_ntz"))
    if f.get("date_to"):
        tests.append(F.col("fecha_procesado") <= F.lit(f["date_to"]).cast("timestamp_ntz"))
    if f.get("supplier_id"):
        tests.append(F.col("proveedor_id") == f["supplier_id"])
    return _all(tests)


def _all(tests: Sequence[Column]) -> Column:
    condition = F.lit(True)
    for t in tests:
        condition = condition & t
    return condition


def page(
    catalog: DataFrame, order_by: str = rules.DEFAULT_ORDER, descending: bool = True, skip: int = 0,
    limit: int = 50, allowed: Sequence[str] = tuple(rules.PAGE_ORDER),
) -> DataFrame:
    """One page in a total order: unknown order columns fall back, the id breaks ties. Cheap for the first pages; for
    deep ones see ``page_at`` and ``page_after``."""
    _checked_limit(limit)
    return catalog.select(*rules.LIST_COLUMNS).orderBy(*_order_keys(order_by, descending, allowed)).offset(skip).limit(limit)


def search_page(catalog: DataFrame, condition: Column, **paging) -> DataFrame:
    return page(catalog.filter(condition), allowed=rules.SEARCH_ORDER, **paging)


def by_id(catalog: DataFrame, document_id: int) -> DataFrame:
    return catalog.filter(F.col("id") == document_id).select(*rules.LIST_COLUMNS)


def newest_first(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy(F.desc("fecha_procesado"), "id")


def details_json() -> Column:
    return F.to_json("detalles_clasificacion")


def note_hunt(catalog: DataFrame, limit: int = 15) -> DataFrame:
    """Documents whose name or details speak of credit or debit notes."""
    name, details = F.lower("filename"), F.lower(details_json())
    tests = [F.contains(name, F.lit(x)) for x in rules.NOTE_NAME_TERMS]
    tests += [F.contains(details, F.lit(x)) for x in rules.NOTE_DETAIL_TERMS]
    return catalog.filter(tx.any_of(tests)).select("id", "filename", "tipo", "proveedor").orderBy("id").limit(limit)


def unknown_preview(catalog: DataFrame, limit: int = 10, length: int = 100) -> DataFrame:
    unknown = catalog.filter(F.col("tipo") == UNKNOWN)
    return unknown.select(
        "id", "filename", "tipo", "proveedor", F.substring(details_json(), 1, length).alias("details_preview")
    ).orderBy("id").limit(limit)


def parse_details(text: Column) -> Column:
    """Method results in stored JSON details; unreadable or missing text gives an empty map."""
    parsed = F.from_json(text, DETAILS)
    empty = F.create_map().cast("map<string,struct<type:string,confidence:double>>")
    return F.coalesce(parsed["method_results"], empty)


def stored_path(root: str) -> Column:
    name = F.regexp_replace(tx.strip(F.col("filename")), r"[\r\n]", "")
    return F.concat_ws("/", F.lit(root), F.col("tipo"), name)


def confidence_band(confidence: Column) -> Column:
    return (
        F.when(confidence >= ensemble.BAND_HIGH, "high").when(confidence >= ensemble.BAND_MEDIUM, "medium")
        .otherwise("low")
    )


def route(docs: DataFrame, root: str) -> DataFrame:
    """Add ``dest_path``: ``<root>/<tipo>/<name>``; of rows that share a path all but the first (by processing time,
    then id) get their processing time before the extension, and those that share the second as well, but for the
    lowest id, their id too.

    One narrow pass counts the rows of each path, combined before the shuffle. Paths that more than one row wants
    become a set of bits of fixed size, and a row whose path is not in it keeps its path where it is: only the others
    are joined with the first row of their path and of their second. Those tables have a row for each colliding path;
    Spark splits a path that many rows share. Null ids, paths or times sort first.
    """
    base = F.concat_ws("/", F.lit(root), F.col("tipo"), F.element_at(F.split("filename", "/"), -1))
    stamp = F.coalesce(F.date_format("processed_at", "yyyyMMdd_HHmmss"), F.lit(""))
    place = F.struct("processed_at", "doc_id")
    narrow = docs.select(base.alias("_dest"), stamp.alias("_stamp"), place.alias("_place"), F.col("doc_id").alias("_id"))
    first = narrow.groupBy("_dest").agg(F.min("_place").alias("_first"), F.count("*").alias("_n")).filter(F.col("_n") > 1).select("_dest", "_first")
    placed = docs.withColumns({"_dest": base, "_stamp": stamp, "_known": bit_set(first, "_dest")})
    clash = may_hold(F.col("_known"), F.col("_dest"))
    alone = placed.filter(~clash).select(*docs.columns, F.col("_dest").alias("dest_path"))
    among = narrow.join(first.select("_dest"), "_dest", "left_semi")
    lowest = among.groupBy("_dest", "_stamp").agg(F.min("_id").alias("_lowest"))
    met = placed.filter(clash).drop("_known").join(first, "_dest", "left").join(lowest, ["_dest", "_stamp"], "left")
    later = F.col("_first").isNotNull() & ~place.eqNullSafe(F.col("_first"))
    number = F.when(~F.col("doc_id").eqNullSafe(F.col("_lowest")), F.concat(F.lit("_"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).otherwise("")
    extension = F.regexp_extract("_dest", r"(\.[^./]*)$", 1)
    stem = F.regexp_replace("_dest", r"\.[^./]*$", "")
    path = F.when(later, F.concat(stem, F.lit("_"), F.col("_stamp"), number, extension)).otherwise(F.col("_dest"))
    return alone.unionByName(met.select(*docs.columns, path.alias("dest_path")))


# ---------------------------------------------------------------- pages of an order


class Order(NamedTuple):
    """A catalog's list columns in one total order, in ranges that follow each other: ``rows`` with ``_range``, and
    ``directory`` with how many rows there are before each range (``_range, n, before``)."""

    rows: DataFrame
    directory: DataFrame
    keys: list[Column]


def _order_keys(order_by: str, descending: bool, allowed: Sequence[str]) -> list[Column]:
    column = order_by if order_by in allowed else rules.DEFAULT_ORDER
    key = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_first()
    return [key, F.col("id").asc()]


def write_order(
    catalog: DataFrame, path: str, order_by: str = rules.DEFAULT_ORDER, descending: bool = True,
    allowed: Sequence[str] = tuple(rules.PAGE_ORDER), ranges: int | None = None,
) -> None:
    """Write ``catalog`` for paging in one order: range-sorted by the order column and the id, so that rows with equal
    values still spread over ranges, a folder each; then a count of each range."""
    keys = _order_keys(order_by, descending, allowed)
    listed = catalog.select(*rules.LIST_COLUMNS)
    spread = listed.repartitionByRange(ranges, *keys) if ranges else listed.repartitionByRange(*keys)
    spread.sortWithinPartitions(*keys).withColumn("_range", F.spark_partition_id()).write.partitionBy("_range").parquet(f"{path}/rows")
    spark = catalog.sparkSession
    written = StructType([*spread.schema.fields, StructField("_range", IntegerType())])
    counts = spark.read.schema(written).parquet(f"{path}/rows").groupBy("_range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    counts.select("_range", "n", F.coalesce(before, F.lit(0)).alias("before")).coalesce(1).write.parquet(f"{path}/directory")


def read_order(spark: SparkSession, path: str, order_by: str = rules.DEFAULT_ORDER, descending: bool = True, allowed: Sequence[str] = tuple(rules.PAGE_ORDER)) -> Order:
    """What ``write_order`` wrote with the same order. A catalog without rows has an empty directory."""
    directory = spark.read.parquet(f"{path}/directory")
    if directory.isEmpty():
        rows = spark.createDataFrame([], SCHEMA).select(*rules.LIST_COLUMNS, F.lit(0).alias("_range"))
    else:
        rows = spark.read.parquet(f"{path}/rows")
    return Order(rows, directory, _order_keys(order_by, descending, allowed))


def page_at(order: Order, skip: int = 0, limit: int = 50) -> DataFrame:
    """Rows ``skip`` to ``skip + limit`` of an order. The directory names the ranges that hold them, one or two as a
    rule; only their folders are read, however deep the page lies."""
    _checked_limit(limit)
    held = order.directory.filter((F.col("before") < skip + limit) & (F.col("before") + F.col("n") > skip)).collect()
    start = {r["_range"]: r["before"] for r in held}  # no more ranges than the page has rows
    rows = order.rows.filter(F.col("_range").isin(*start)) if start else order.rows.filter(F.lit(False))
    before = F.lit(0).cast("long")
    for r, n in start.items():
        before = F.when(F.col("_range") == r, n).otherwise(before)
    place = before + F.row_number().over(Window.partitionBy("_range").orderBy(*order.keys)) - 1
    page = rows.withColumn("_place", place).filter((F.col("_place") >= skip) & (F.col("_place") < skip + limit))
    return page.orderBy("_place").drop("_place", "_range")


def page_after(
    catalog: DataFrame, after: tuple[object, int] | None = None, order_by: str = rules.DEFAULT_ORDER, descending: bool = True,
    limit: int = 50, allowed: Sequence[str] = tuple(rules.PAGE_ORDER),
) -> DataFrame:
    """The page that follows ``after``, the order value and id of the last row seen (None: the first page).

    What lies before is filtered away where the files are read, so the next page costs what the first one does.
    """
    _checked_limit(limit)
    column = order_by if order_by in allowed else rules.DEFAULT_ORDER
    rows = catalog
    if after is not None:
        value, last = after
        c, tie = F.col(column), F.col("id") > last
        if value is None:
            beyond = c.isNull() & tie if descending else (c.isNull() & tie) | c.isNotNull()
        else:
            further = (c < F.lit(value)) | c.isNull() if descending else c > F.lit(value)
            beyond = further | ((c == F.lit(value)) & tie)
        rows = rows.filter(beyond)
    return rows.select(*rules.LIST_COLUMNS).orderBy(*_order_keys(order_by, descending, allowed)).limit(limit)


def _checked_limit(limit: int) -> None:
    if not 1 <= limit <= rules.PAGE_LIMIT:
        raise ValueError(f"limit must be between 1 and {rules.PAGE_LIMIT}")


# ---------------------------------------------------------------- statistics


def count_by(catalog: DataFrame, column: str) -> DataFrame:
    return catalog.groupBy(column).agg(F.count("*").alias("n"))


def top_suppliers(catalog: DataFrame, k: int = 10) -> DataFrame:
    named = catalog.select(F.coalesce("proveedor", F.lit(rules.NO_SUPPLIER)).alias("proveedor"))
    return count_by(named, "proveedor").orderBy(F.desc("n"), "proveedor").limit(k)


def average_confidence(catalog: DataFrame) -> DataFrame:
    """Mean over known confidences; 0 without any."""
    return catalog.agg(F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 3).alias("avg_confidence"))


def average_confidence_all_rows(catalog: DataFrame) -> DataFrame:
    """Mean over all rows, where an unknown confidence counts as 0."""
    mean = F.sum(F.coalesce("confidence", F.lit(0.0))) / F.count("*")
    return catalog.agg(F.round(F.coalesce(mean, F.lit(0.0)), 3).alias("avg_confidence"))


def confidence_by_type(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("tipo").agg(F.avg("confidence").alias("avg_confidence")).filter(
        F.col("avg_confidence").isNotNull()).orderBy(F.desc("avg_confidence"), "tipo")


def recent_count(catalog: DataFrame, as_of: datetime) -> DataFrame:
    """Documents processed in the 24 hours before ``as_of``."""
    start = F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz") - F.expr("INTERVAL 1 DAY")
    return catalog.filter(F.col("fecha_procesado") > start).agg(F.count("*").alias("recent_documents"))


def per_day(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy(F.to_date("fecha_procesado").alias("day")).agg(F.count("*").alias("n"))


def latest_days(catalog: DataFrame, days: int = 7) -> DataFrame:
    return per_day(catalog).orderBy(F.desc("day")).limit(days)


def overview(catalog: DataFrame) -> DataFrame:
    """Totals of an export: documents, mean confidence, types, suppliers, most common type (of equal
    counts the one met first when newest documents come first)."""
    per_type = catalog.groupBy("tipo").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("confidence", F.lit(0.0))).alias("c"),
        F.max(F.struct("fecha_procesado", (-F.col("id")).alias("o"))).alias("latest"),
    )
    suppliers = catalog.agg(F.countDistinct(F.nullif("proveedor_id", F.lit("")))).scalar()
    return per_type.agg(
        F.sum("n").alias("total_documentos"),
        F.round(F.sum("c") / F.sum("n"), 3).alias("confianza_promedio"),
        F.count("*").alias("tipos_documento"),
        F.max_by("tipo", F.struct("n", "latest")).alias("tipo_mas_comun"),
    ).withColumn("proveedores_unicos", suppliers)


def counts_wide(catalog: DataFrame, types: Sequence[str]) -> DataFrame:
    """One row with a ``count_<type>`` column per type."""
    return catalog.agg(*[F.count_if(F.col("tipo") == t).alias(f"count_{t}") for t in types])


def distinct_types(catalog: DataFrame) -> DataFrame:
    return catalog.select("tipo").distinct().orderBy("tipo")


def distinct_suppliers(catalog: DataFrame) -> DataFrame:
    return catalog.filter(F.col("proveedor").isNotNull()).select("proveedor").distinct().orderBy("proveedor")


# ---------------------------------------------------------------- parts of names and numbers


#: Characters of the grams by which a part of a value is found; a shorter part is looked for in every row.
GRAM = 3
#: Candidates up to which a search names their ids to the files; beyond, rows meet the candidates by a join.
NAMED_IDS = 1000


def _grams(value: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(value, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def write_search_index(catalog: DataFrame, path: str, columns: Sequence[str] = ("cuit", "proveedor")) -> None:
    """Write which ids hold each stretch of ``GRAM`` characters in each of ``columns``: a bitmap for every 32,768 ids, so
    that one that nearly all rows hold is as many short rows as there are ranges of ids. Sorted by gram, so a search
    reads few row groups."""
    held = [catalog.select("id", F.lit(c).alias("field"), F.explode(_grams(F.col(c))).alias("gram")) for c in columns]
    rows = held[0]
    for h in held[1:]:
        rows = rows.unionByName(h)
    bits = rows.groupBy("field", "gram", F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
    bits.repartitionByRange("field", "gram", "bucket").sortWithinPartitions("field", "gram", "bucket").write.partitionBy("field").parquet(path)


def search_candidates(index: DataFrame, field: str | None = None, part: str | None = None, **parts: str) -> DataFrame:
    """``id`` of the rows whose ``field`` holds every gram of ``part``: all that may hold it, and few others. With more
    than one of ``parts``, their bitmaps are intersected before ids are made of them."""
    wanted = parts if field is None else {field: part, **parts}
    tests, n = [], 0
    for name, value in wanted.items():
        grams = sorted({value[i : i + GRAM] for i in range(len(value) - GRAM + 1)})
        if not grams:
            raise ValueError(f"a part needs at least {GRAM} characters")
        tests.append((F.col("field") == name) & F.col("gram").isin(*grams))
        n += len(grams)
    found = index.filter(tx.any_of(tests))
    both = found.groupBy("bucket").agg(F.count("*").alias("n"), F.bitmap_and_agg("bits").alias("bits")).filter(F.col("n") == n)
    octet = F.posexplode(F.transform(F.sequence(F.lit(1), F.octet_length("bits")), lambda i: F.conv(F.hex(F.substring("bits", i, 1)), 16, 10).cast("int")))
    octets = both.select("bucket", octet.alias("k", "octet")).filter(F.col("octet") != 0)
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda b: F.call_function("shiftright", F.col("octet"), b).bitwiseAND(F.lit(1)) == 1))
    place = octets.select("bucket", "k", bit.alias("b")).select("bucket", (F.col("k") * 8 + F.col("b")).alias("place"))
    # the first id of bucket 1 is 1; ids of 0 and below count downwards in the buckets from 0
    above, below = (F.col("bucket") - 1) * 32768 + F.col("place") + 1, F.col("bucket") * 32768 - F.col("place")
    return place.select(F.when(F.col("bucket") > 0, above).otherwise(below).alias("id"))


def search_indexed(catalog: DataFrame, index: DataFrame, condition: Column, **parts: str) -> DataFrame:
    """Rows of ``catalog`` that satisfy ``condition`` and hold every given part (``cuit="30-0"``) in its column.

    Bitmaps of the parts' grams are intersected; the candidates, by their ids, are all of the catalog that the test
    itself is made on. Parts of fewer than ``GRAM`` characters are tested on every row.
    """
    rows = catalog.filter(condition)
    for field, part in parts.items():
        rows = rows.filter(F.contains(field, F.lit(part)))
    usable = {f: p for f, p in parts.items() if len(p) >= GRAM}
    if not usable:
        return rows
    ids = search_candidates(index, **usable)
    few = [r["id"] for r in ids.limit(NAMED_IDS + 1).collect()]
    if not few:
        return rows.filter(F.lit(False))
    if len(few) <= NAMED_IDS:
        return rows.filter(F.col("id").isin(*few))
    # bitmaps are small files of many ids, so their size says nothing: the ids are never gathered for a broadcast
    return rows.join(ids.hint("merge"), "id", "left_semi")
