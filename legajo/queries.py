"""Named queries over the given tables: one or more per operator."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from legajo.functions import metadata as md
from legajo.functions import scoring as sc
from legajo.functions import text as tx
from legajo.operators import audit, bayes, classify, consensus, layout, pages, review, suppliers, validation
from legajo.operators import catalog as cat
from legajo.plans import batch
from legajo.rules import catalog as catalog_rules
from legajo.rules import edit, patterns, types
from legajo.rules import layout as layout_rules
from legajo.rules.ensemble import DOMAIN_THRESHOLD
from legajo.session import new_path, written_table
from legajo.sources import derived, exports, files, versions
from legajo.sources.registry import (
    built_in_registry, built_in_rows, read_registry_lines, registry_patterns, write_registry, write_registry_lines,
)
from legajo.sources.tables import business_docs, table
from legajo.streaming import ingest as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Reference time of queries about recent documents.
AS_OF = datetime(2001, 8, 1, 12, 0, 0)
QUARANTINE_AT = datetime(2025, 9, 25, 9, 39, 40)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def moment(value: datetime) -> Column:
    """A time that does not depend on the session's time zone."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def r6(column: Column | str) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


def listed(column: Column | str) -> Column:
    return F.array_join(column, "|")


def big(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint")


# ---------------------------------------------------------------- tables written once


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes and suppliers of the business documents, as the catalog stores them: texts are classified once."""
    results = F.col("detalles_clasificacion.method_results")
    return catalog(spark, sf_dir).select(
        F.col("id").alias("doc_id"), *[F.try_element_at(results, F.lit(m)).alias(m) for m in classify.RULE_METHODS],
        F.col("proveedor_id").alias("supplier_id"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        return cat.catalog_rows(cat.classify(business_docs(spark, sf_dir)))

    return written_table(spark, "catalog", sf_dir, build, ("tipo",))


def decided(spark: SparkSession, sf_dir: str, methods=classify.RULE_METHODS) -> DataFrame:
    return cat.classify(business_docs(spark, sf_dir), methods=methods)


# ---------------------------------------------------------------- scoring


@query
def flagship_types_confidence(spark, sf):
    """How many documents of each type, and how sure: keyword and pattern methods with the vote."""
    done = decided(spark, sf, ("keyword", "regex"))
    return done.groupBy("tipo").agg(F.count("*").alias("n"), r6(F.avg("confidence")).alias("avg_confidence"))


def _votes_of(method: str) -> Query:
    def run(spark, sf):
        voted = classify.rule_votes(business_docs(spark, sf).select("doc_id", "text"), [method])
        return voted.select("doc_id", F.col(f"{method}.type").alias("type"), r6(f"{method}.confidence").alias("confidence"))

    return run


QUERIES["keyword_scores"] = _votes_of("keyword")
QUERIES["regex_scores"] = _votes_of("regex")
QUERIES["agro_scores"] = _votes_of("agro")
QUERIES["commercial_scores"] = _votes_of("commercial")


@query
def keyword_scores_documents(spark, sf):
    """Keyword method over the long multilingual texts."""
    voted = classify.rule_votes(table(spark, sf, "documents").select("doc_id", "text"), ["keyword"])
    return voted.select("doc_id", F.col("keyword.type").alias("type"), r6("keyword.confidence").alias("confidence"))


@query
def keyword_details(spark, sf):
    done = classify.keyword_details(business_docs(spark, sf).select("doc_id", "text"))
    long = done.select("doc_id", "keywords_found", F.explode("scores").alias("doc_type", "score"))
    return long.filter(F.col("score") > 0).select(
        "doc_id", "doc_type", r6("score").alias("score"),
        F.coalesce(listed(F.try_element_at("keywords_found", F.col("doc_type"))), F.lit("")).alias("keywords"),
    )


@query
def term_profile(spark, sf):
    return classify.term_profile(business_docs(spark, sf)).select("doc_id", "term", big("n").alias("n"))


@query
def legacy_first_match(spark, sf):
    return batch.legacy_rows(business_docs(spark, sf)).select("id", "filename", "tipo", "cuit")


@query
def regex_match_details(spark, sf):
    return classify.pattern_details(business_docs(spark, sf).select("doc_id", "text")).select(
        "doc_id", "type", big("pattern_no").alias("pattern_no"), big("n_matches").alias("n_matches"),
        listed("matches").alias("matches"),
    )


@query
def doc_structure(spark, sf):
    done = classify.document_structure(business_docs(spark, sf).select("doc_id", "text"))
    return done.select("doc_id", *sc.STRUCTURE_FLAGS, r6("structure_score").alias("structure_score"))


@query
def domain_flags(spark, sf):
    v = votes(spark, sf)
    return v.select(
        "doc_id", sc.in_domain(F.col("agro.confidence"), DOMAIN_THRESHOLD).alias("is_agro"),
        sc.in_domain(F.col("commercial.confidence"), DOMAIN_THRESHOLD).alias("is_commercial"),
    )


@query
def agro_indicators(spark, sf):
    found = business_docs(spark, sf).select("doc_id", sc.agro_indicators(F.col("text")).alias("i"))
    names = ["grains_mentioned", "weights_found", "prices_found", "quality_params", "dates_found"]
    return found.select("doc_id", *[listed(f"i.{n}").alias(n) for n in names])


@query
def commercial_indicators(spark, sf):
    found = business_docs(spark, sf).select("doc_id", sc.commercial_indicators(F.col("text")).alias("i"))
    names = ["amounts_found", "account_numbers", "banks_mentioned", "payment_methods", "dates_found"]
    return found.select("doc_id", *[listed(f"i.{n}").alias(n) for n in names])


# ---------------------------------------------------------------- metadata


def _extracted(name: str, extract: Callable[[Column], Column]) -> None:
    QUERIES[f"meta_{name}"] = lambda spark, sf: business_docs(spark, sf).select(
        "doc_id", extract(F.col("text")).alias(name)
    )


_extracted("cuit", md.tax_id)
_extracted("dates", lambda t: listed(md.dates(t)))
_extracted("amounts", lambda t: listed(md.amounts(t)))
_extracted("supplier", md.supplier_name)
_extracted("document_number", md.document_number)


@query
def meta_all(spark, sf):
    m = business_docs(spark, sf).select("doc_id", md.metadata(F.col("text"), moment(AS_OF)).alias("m"))
    return m.select(
        "doc_id", "m.cuit", listed("m.dates").alias("dates"), listed("m.amounts").alias("amounts"), "m.supplier",
        "m.document_number", F.date_format("m.extracted_at", "yyyy-MM-dd HH:mm:ss").alias("extracted_at"),
    )


# ---------------------------------------------------------------- suppliers


@query
def supplier_detect(spark, sf):
    done = suppliers.detect_supplier(business_docs(spark, sf).select("doc_id", "text"), built_in_rows())
    return done.select("doc_id", "supplier_id", r6("supplier_confidence").alias("supplier_confidence"))


@query
def supplier_detect_joined(spark, sf):
    """The built-in registry as a table: the same result by the join."""
    done = suppliers.detect_supplier(business_docs(spark, sf).select("doc_id", "text"), built_in_registry(spark))
    return done.select("doc_id", "supplier_id", r6("supplier_confidence").alias("supplier_confidence"))


@query
def supplier_detect_registry(spark, sf):
    """The suppliers of the raw tables, by tax id and a name of two words."""
    base = derived.supplier_registry(spark, sf)
    entry = F.create_map().cast("map<string,struct<specific_terms:array<string>,layout_indicators:array<string>,confidence_boost:double>>")
    registry = base.select("ord", "supplier_id", "names", "cuit", entry.alias("document_patterns"))
    done = suppliers.detect_supplier(business_docs(spark, sf).select("doc_id", "text"), registry)
    return done.select("doc_id", "supplier_id", r6("supplier_confidence").alias("supplier_confidence"))


@query
def supplier_fields(spark, sf):
    found = business_docs(spark, sf).select("doc_id", md.supplier_fields(F.col("text")).alias("f"))
    return found.select("doc_id", F.explode("f").alias("field", "value"))


@query
def supplier_lookup(spark, sf):
    done = suppliers.supplier_lookup(votes(spark, sf).select("doc_id", "supplier_id"), built_in_registry(spark))
    return done.select("doc_id", "supplier_id", listed("names").alias("names"), "cuit")


@query
def supplier_boost(spark, sf):
    typed = catalog(spark, sf).select("id", F.col("proveedor_id").alias("supplier_id"), F.col("tipo").alias("doc_type"))
    done = suppliers.supplier_boost(typed, built_in_registry(spark), id_column="id")
    return done.select("id", "supplier_id", "doc_type", r6("supplier_boost").alias("supplier_boost"))


@query
def supplier_search(spark, sf):
    found = suppliers.search_suppliers(derived.supplier_registry(spark, sf), "7")
    return found.select("supplier_id", listed("names").alias("name"), "cuit", "match_score")


@query
def registry_upsert(spark, sf):
    """Suppliers in debt get a new name; suppliers of one nation are added under a new id."""
    current = derived.supplier_registry(spark, sf).select("supplier_id", F.element_at("names", 1).alias("name"), "in_debt", "nation")
    renamed = current.filter("in_debt").select("supplier_id", F.concat(F.col("name"), F.lit(" (deudor)")).alias("name"))
    added = current.filter(F.col("nation") == 1).select(F.concat(F.lit("new_"), "supplier_id").alias("supplier_id"), "name")
    return suppliers.upsert(current.select("supplier_id", "name"), renamed.unionByName(added), "supplier_id")


@query
def registry_update_existing(spark, sf):
    current = derived.supplier_registry(spark, sf).select("supplier_id", F.element_at("names", 1).alias("name"), "in_debt", "nation")
    changes = current.filter("in_debt").select("supplier_id", F.upper("name").alias("name"))
    unknown = current.filter(F.col("nation") == 1).select(F.concat(F.lit("new_"), "supplier_id").alias("supplier_id"), "name")
    return suppliers.update_existing(current.select("supplier_id", "name"), changes.unionByName(unknown), "supplier_id")


@query
def registry_merge_terms(spark, sf):
    base = derived.supplier_registry(spark, sf)
    name = F.element_at("names", 1)
    flat = base.select(
        "supplier_id", F.lit("facturas").alias("doc_type"), F.array(F.upper(name)).alias("specific_terms"),
        F.array(F.lit("PRÓXIMO VENCIMIENTO")).alias("layout_indicators"), F.lit(0.3).alias("confidence_boost"),
    )
    kind = F.when(F.col("in_debt"), "recibos").otherwise("facturas")
    additions = base.select(
        "supplier_id", kind.alias("doc_type"), F.array(F.lower(name), F.col("cuit")).alias("new_terms"),
        F.array(F.lit("próximo vencimiento"), F.lit("TRACKING")).alias("new_indicators"),
    )
    merged = suppliers.merge_patterns(flat, additions, base)
    return merged.select(
        "supplier_id", "doc_type", listed("specific_terms").alias("specific_terms"),
        listed("layout_indicators").alias("layout_indicators"), "confidence_boost",
    )


# ---------------------------------------------------------------- votes and decision


@query
def votes_long(spark, sf):
    return consensus.votes_long(votes(spark, sf), classify.RULE_METHODS).select(
        "doc_id", "method", "type", r6("confidence").alias("confidence")
    )


@query
def consensus_stats(spark, sf):
    stats = consensus.consensus_stats(consensus.votes_long(votes(spark, sf), classify.RULE_METHODS))
    return stats.select(
        "doc_id", "type", "vote_count", r6("vote_percentage").alias("vote_percentage"),
        r6("avg_confidence").alias("avg_confidence"), r6("max_confidence").alias("max_confidence"),
        listed("supporting_methods").alias("methods"),
    )


@query
def consensus_best(spark, sf):
    stats = consensus.consensus_stats(consensus.votes_long(votes(spark, sf), classify.RULE_METHODS))
    return consensus.best_consensus(stats).select(
        "doc_id", "best_consensus", big("vote_count").alias("vote_count"), big("total_methods").alias("total_methods"),
        "has_strong_consensus",
    )


@query
def weighted_scores(spark, sf):
    scores = consensus.weighted_scores(consensus.votes_long(votes(spark, sf), classify.RULE_METHODS))
    return scores.select("doc_id", "type", r6("score").alias("score"))


@query
def ensemble(spark, sf):
    """The whole decision from the text: four rule methods, supplier, consensus, shortcuts."""
    done = decided(spark, sf)
    return done.select(
        "doc_id", "tipo", r6("confidence").alias("confidence"), "supplier_id",
        r6("decision.supplier_boost").alias("supplier_boost"), r6("decision.consensus_factor").alias("consensus_factor"),
        "consensus.best_consensus", "consensus.has_strong_consensus", big("consensus.total_methods").alias("total_methods"),
    )


@query
def ensemble_reason(spark, sf):
    v = consensus.decide(votes(spark, sf), classify.RULE_METHODS, registry_patterns(built_in_registry(spark)))
    return v.select("doc_id", F.col("decision.reasoning").alias("reasoning"))


@query
def ensemble_reason_two_methods(spark, sf):
    """Keyword and pattern methods only, where most decisions come from the vote."""
    v = consensus.decide(votes(spark, sf), ("keyword", "regex"), registry_patterns(built_in_registry(spark)))
    return v.select("doc_id", "tipo", F.col("decision.reasoning").alias("reasoning"))


@query
def ensemble_user_weights(spark, sf):
    """Votes weighted by the caller instead of the defaults."""
    v = consensus.decide(
        votes(spark, sf), ("keyword", "regex"), registry_patterns(built_in_registry(spark)),
        {"keyword": 0.5, "regex": 0.5},
    )
    return v.select("doc_id", "tipo", r6("confidence").alias("confidence"))


@query
def ensemble_user_scorer(spark, sf):
    """A scorer of the caller's own, which sees contracts in every fourth document, votes with the others."""
    docs = business_docs(spark, sf)
    every_fourth = F.col("doc_id") % 4 == 0
    own = docs.select(
        "doc_id", F.when(every_fourth, "contratos").otherwise(types.UNKNOWN).alias("type"),
        F.when(every_fourth, 0.7).otherwise(0.0).alias("confidence"),
    )
    done = cat.classify(
        docs, None, ("keyword", "regex"), {"contract_scorer": own},
        {"keyword": 0.15, "regex": 0.15, "contract_scorer": 0.4},
    )
    rows = cat.catalog_rows(done)
    details = F.col("detalles_clasificacion")
    return rows.select(
        "id", "tipo", r6("confidence").alias("confidence"), details["consensus"]["best_consensus"].alias("best_consensus"),
        big(details["consensus"]["total_methods"]).alias("total_methods"), listed("metodos_usados").alias("methods"),
        details["decision"]["reasoning"].alias("reasoning"),
        r6(F.try_element_at(details["method_results"], F.lit("contract_scorer"))["confidence"]).alias("own_confidence"),
    )


@query
def rule_edit_keywords(spark, sf):
    """A new type for the keyword method."""
    rules = edit.with_type(types.TYPE_KEYWORDS, "silos", ["trigo", "SOJA", "depósito"])
    voted = classify.rule_votes(business_docs(spark, sf).select("doc_id", "text"), ["keyword"], keywords=rules)
    return voted.select("doc_id", F.col("keyword.type").alias("type"), r6("keyword.confidence").alias("confidence"))


# One pattern for each form that an edit must keep: anchors, a negated class, an escaped letter, a named group.
EDITED = [r"\AFACTURA", r"TOTAL\s\$\s\d+\.00\Z", r"CR\xC9DITO", r"(?P<Num>\d{8})-(?P<Digit>\d)$", r"N\S\s[^A-Z\s]+", r"[A-Z]+ARG[A-Z]+"]


@query
def rule_edit_patterns(spark, sf):
    rules = {t: p for t, p in patterns.TYPE_PATTERNS.items() if t != "facturas"}
    for pattern in EDITED:
        rules = edit.with_pattern(rules, "ediciones", pattern)
    voted = classify.rule_votes(business_docs(spark, sf).select("doc_id", "text"), ["regex"], exprs=rules)
    return voted.select("doc_id", F.col("regex.type").alias("type"), r6("regex.confidence").alias("confidence"))


def _all_methods(spark, sf, *shown: Column) -> DataFrame:
    """All six methods' votes and the decision; with the columns ``shown`` of the layout scores (NULL without spans)."""
    docs = business_docs(spark, sf)
    model = built_in_model(spark, sf)
    ml = bayes.predict(docs, model)
    laid = layout.layout_scores(derived.spans(spark, sf)).select("doc_id", "layout.*", *shown)
    return consensus.decide(
        _joined(votes(spark, sf), {"ml": ml, "layout": laid}), (*classify.RULE_METHODS, "ml", "layout"),
        registry_patterns(built_in_registry(spark)),
    )


def _joined(voted: DataFrame, extra: dict[str, DataFrame]) -> DataFrame:
    for name, v in extra.items():
        more = [c for c in v.columns if c not in ("doc_id", "type", "confidence")]
        voted = voted.join(v.select("doc_id", *more, F.struct("type", "confidence").alias(name)), "doc_id", "left")
        voted = voted.withColumn(name, F.coalesce(name, sc.no_vote()))
    return voted


@query
def ensemble_all_methods(spark, sf):
    """All six methods, with Naive Bayes and layout."""
    return _all_methods(spark, sf).select(
        "doc_id", "tipo", r6("confidence").alias("confidence"), F.col("ml.type").alias("ml_type"),
        F.col("layout.type").alias("layout_type"), "consensus.best_consensus",
    )


@query
def full_analysis(spark, sf):
    """Decision and per-method details of every document."""
    docs = business_docs(spark, sf).select("doc_id", "text")
    details = classify.keyword_details(docs).select(
        "doc_id", big(F.size("keywords_found")).alias("keyword_types"),
        F.try_element_at(md.supplier_fields(F.col("text")), F.lit("razón_social")).alias("razon_social"),
    )
    found = classify.pattern_details(docs).groupBy("doc_id").agg(F.count("*").alias("patterns_hit"))
    everything = _all_methods(spark, sf).select("doc_id", "tipo", r6("confidence").alias("confidence"))
    return everything.join(details, "doc_id").join(found, "doc_id", "left").select(
        "doc_id", "tipo", "confidence", "keyword_types", "razon_social",
        F.coalesce("patterns_hit", F.lit(0)).cast("bigint").alias("patterns_hit"),
    )


@query
def full_analysis_details(spark, sf):
    """The whole analysis of every document: each method's vote, class probabilities, layout, structure, supplier, reason."""
    docs = business_docs(spark, sf).select("doc_id", "text")
    structure = classify.document_structure(docs).select("doc_id", r6("structure_score").alias("structure_score"))
    chances = bayes.probability_map(docs, built_in_model(spark, sf)).select("doc_id", r6(F.array_max(F.map_values("probabilities"))).alias("ml_probability"))
    laid = [r6(F.greatest(*[f"score_{t}" for t in layout_rules.TYPES])).alias("layout_score"), big("total_blocks").alias("total_blocks")]
    every = _all_methods(spark, sf, *laid).filter(F.col("total_blocks").isNotNull())  # documents with a layout
    methods = [*classify.RULE_METHODS, "ml", "layout"]
    shown = every.select(
        "doc_id", "tipo", r6("confidence").alias("confidence"), "supplier_id", F.col("decision.reasoning").alias("reasoning"),
        *[c for m in methods for c in (F.col(f"{m}.type").alias(f"{m}_type"), r6(f"{m}.confidence").alias(f"{m}_confidence"))],
        "layout_score", "total_blocks",
    )
    return shown.join(structure, "doc_id").join(chances, "doc_id").select(
        *[c for c in shown.columns if c not in ("layout_score", "total_blocks")], "structure_score", "ml_probability", "layout_score", "total_blocks",
    )


# ---------------------------------------------------------------- catalog


SHOWN = ["id", "filename", "tipo", "cuit", "proveedor", "fecha_documento", "monto"]


def _shown(df: DataFrame) -> DataFrame:
    return df.select(*SHOWN, r6("confidence").alias("confidence"))


def _search(name: str, **filters) -> None:
    QUERIES[f"catalog_search_{name}"] = lambda spark, sf: _shown(catalog(spark, sf).filter(cat.search_filter(**filters)))


_search("cuit", cuit="30-000001")
_search("supplier", proveedor="TELECOM")
_search("type", tipo="facturas")
_search("date", fecha_desde="1996-03-01", fecha_hasta="1996-09-30")
_search("amount", monto_min=100000, monto_max=250000.5)
_search("amount_strict", monto_min=100000, monto_max=250000.5, amounts="strict")
_search("confidence", confidence_min=0.5)
_search("combined", proveedor="EDESUR", tipo="facturas", confidence_min=0.3, fecha_desde="1997-01-01", monto_min=50000)


def _indexed(name: str, condition: Callable[[], Column], **parts: str) -> None:
    def run(spark, sf):
        path = new_path(spark, "search-index")
        cat.write_search_index(catalog(spark, sf), path)
        return _shown(cat.search_indexed(catalog(spark, sf), spark.read.parquet(path), condition(), **parts))

    QUERIES[f"catalog_search_indexed_{name}"] = run


_indexed("cuit", lambda: F.lit(True), cuit="30-000001")
_indexed("both", lambda: cat.search_filter(tipo="facturas"), proveedor="TELECOM", cuit="0-0")


@query
def catalog_rows(spark, sf):
    """Every catalog row, built from the text in one pass."""
    rows = cat.catalog_rows(decided(spark, sf))
    return rows.select(
        *SHOWN, "proveedor_id", r6("confidence").alias("confidence"), "doc_date",
        F.col("amount").cast("double").alias("amount"),
    )


@query
def catalog_page(spark, sf):
    return _shown(cat.page(catalog(spark, sf), order_by="confidence", skip=100, limit=50))


@query
def catalog_page_fallback_order(spark, sf):
    return _shown(cat.page(catalog(spark, sf), order_by="monto; DROP", descending=False, skip=20, limit=50))


@query
def catalog_search_page(spark, sf):
    return _shown(cat.search_page(
        catalog(spark, sf), cat.search_filter(tipo="facturas"), order_by="cuit", descending=False, skip=10, limit=25
    ))


def _ordered(spark, sf, order_by: str, descending: bool) -> cat.Order:
    path = new_path(spark, f"order-{order_by}")
    cat.write_order(catalog(spark, sf), path, order_by, descending, ranges=16)
    return cat.read_order(spark, path, order_by, descending)


@query
def catalog_page_seek(spark, sf):
    """A page far down an order, from the one or two ranges that hold it."""
    return _shown(cat.page_at(_ordered(spark, sf, "confidence", True), skip=1100, limit=70))


@query
def catalog_pages_whole(spark, sf):
    """Every row with the number of its page, from the ranges and their directory."""
    order = _ordered(spark, sf, "filename", False)
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*order.keys))
    numbered = order.rows.join(F.broadcast(order.directory), "_range")  # a row for each range
    return numbered.select("id", F.floor((F.col("before") + local - 1) / 50).alias("page"))


@query
def catalog_search_page_after(spark, sf):
    """The third page of a search, each from where the one before it ended."""
    found, last = catalog(spark, sf).filter(cat.search_filter(tipo="facturas")), None
    for _ in range(3):
        seen = cat.page_after(found, last, "cuit", False, limit=25, allowed=catalog_rules.SEARCH_ORDER)
        end = seen.select("cuit", "id").collect()[-1:]  # a page
        last = (end[0]["cuit"], end[0]["id"]) if end else last
    return _shown(seen)


@query
def catalog_by_id(spark, sf):
    return _shown(cat.by_id(catalog(spark, sf), 1200))


@query
def cli_search(spark, sf):
    return _shown(catalog(spark, sf).filter(cat.cli_filter(proveedor="EDESUR", tipo="facturas")))


@query
def note_hunt(spark, sf):
    """Documents whose details name a note type, found in their decision text."""
    return cat.note_hunt(catalog(spark, sf).withColumn("filename", F.concat("tipo", F.lit("_"), "filename")))


@query
def unknown_preview(spark, sf):
    return cat.unknown_preview(catalog(spark, sf))


@query
def review_queue(spark, sf):
    return review.review_queue(catalog(spark, sf)).withColumn("confidence", r6("confidence"))


@query
def review_apply(spark, sf):
    c = catalog(spark, sf)
    return review.apply_overrides(c.select("id", "filename", "tipo"), derived.corrections(c))


def _with_legacy(spark, sf) -> DataFrame:
    return cat.merge_tables(catalog(spark, sf), batch.legacy_rows(business_docs(spark, sf)))


@query
def legacy_merge(spark, sf):
    """The six-column rows of the earlier version merged with the catalog."""
    merged = _with_legacy(spark, sf)
    return merged.groupBy("tipo", F.col("confidence").isNull().alias("is_legacy")).agg(
        F.count("*").alias("n"), F.count("cuit").alias("with_cuit"), F.count("proveedor").alias("with_supplier")
    )


@query
def details_parse(spark, sf):
    """Stored JSON details read back; every fifth text is cut short and gives no methods."""
    stored = catalog(spark, sf).select("id", cat.details_json().alias("j"))
    text = F.when(F.col("id") % 5 == 0, F.substring("j", 1, 20)).otherwise(F.col("j"))
    parsed = stored.select("id", cat.parse_details(text).alias("m"))
    return parsed.select(
        "id", big(F.size("m")).alias("n_methods"), F.try_element_at("m", F.lit("keyword"))["type"].alias("keyword_type"),
        r6(F.try_element_at("m", F.lit("commercial"))["confidence"]).alias("commercial_confidence"),
    )


@query
def stored_path(spark, sf):
    padded = catalog(spark, sf).withColumn("filename", F.concat(F.lit("  "), "filename", F.lit("\r\n ")))
    return padded.select("id", cat.stored_path("output_pdfs").alias("path"))


@query
def route_collisions(spark, sf):
    """Files named after the tax id, so that many share a destination."""
    named = catalog(spark, sf).select(
        F.col("id").alias("doc_id"), F.concat("cuit", F.lit(".pdf")).alias("filename"), "tipo",
        F.col("fecha_procesado").alias("processed_at"),
    )
    return cat.route(named, "output_pdfs").select("doc_id", "dest_path")


@query
def newest_first(spark, sf):
    """Simple export of one type, newest first."""
    return exports.by_type(catalog(spark, sf), "notas_credito").select("id", "filename", "monto")


# ---------------------------------------------------------------- statistics


@query
def stats_total(spark, sf):
    return catalog(spark, sf).agg(F.count("*").alias("total"))


@query
def stats_by_type(spark, sf):
    return cat.count_by(catalog(spark, sf), "tipo")


@query
def stats_top_suppliers(spark, sf):
    return cat.top_suppliers(catalog(spark, sf))


@query
def stats_avg_conf(spark, sf):
    """Over the catalog and the rows of the earlier version, whose confidence is not known."""
    return cat.average_confidence(_with_legacy(spark, sf))


@query
def stats_avg_conf_all_rows(spark, sf):
    return cat.average_confidence_all_rows(_with_legacy(spark, sf))


@query
def stats_avg_conf_by_type(spark, sf):
    return cat.confidence_by_type(catalog(spark, sf)).withColumn("avg_confidence", r6("avg_confidence"))


@query
def stats_recent(spark, sf):
    return cat.recent_count(catalog(spark, sf), AS_OF)


@query
def stats_by_day(spark, sf):
    return cat.per_day(catalog(spark, sf))


@query
def stats_by_day_7(spark, sf):
    return cat.latest_days(catalog(spark, sf))


@query
def stats_overview(spark, sf):
    return cat.overview(catalog(spark, sf))


@query
def stats_wide(spark, sf):
    return cat.counts_wide(catalog(spark, sf), [*types.TYPE_KEYWORDS, types.UNKNOWN])


@query
def confidence_bands(spark, sf):
    banded = catalog(spark, sf).select(cat.confidence_band(F.col("confidence")).alias("band"))
    return banded.groupBy("band").agg(F.count("*").alias("n"))


@query
def distinct_types(spark, sf):
    return cat.distinct_types(catalog(spark, sf))


@query
def distinct_suppliers(spark, sf):
    return cat.distinct_suppliers(catalog(spark, sf))


# ---------------------------------------------------------------- processing


def _processed(spark, sf) -> batch.Processed:
    return batch.process(
        business_docs(spark, sf), derived.manifest(spark, sf), None, moment(QUARANTINE_AT),
        store=lambda rows: written_table(spark, "processed", sf, lambda: rows, ("tipo",)),
    )


@query
def process_documents(spark, sf):
    """Result row of every document of a run, accepted or not."""
    return _processed(spark, sf).results.select(
        "doc_id", "success", "error", "classification", r6("confidence").alias("confidence"), "destination"
    )


@query
def batch_summary(spark, sf):
    return batch.summary(_processed(spark, sf).results)


@query
def batch_summary_by_type(spark, sf):
    return batch.summary_by_type(_processed(spark, sf).results)


@query
def reprocess_unknown(spark, sf):
    """Every stored unknown document classified again."""
    c = catalog(spark, sf)
    again = batch.reprocess(c, c.filter(F.col("tipo") == types.UNKNOWN))
    return again.select("id", "tipo", r6("confidence").alias("confidence"))


@query
def classification_log(spark, sf):
    v = decided(spark, sf)
    rows = audit.classification_log(v.withColumn("filename", F.col("doc_id").cast("string")), classify.RULE_METHODS)
    return rows.select(
        "document_path", "final_classification", r6("final_confidence").alias("final_confidence"),
        "decision_reasoning", r6(F.get_json_object("method_results", "$.keyword.confidence").cast("double")).alias("keyword_confidence"),
    )


@query
def op_timings(spark, sf):
    return audit.operation_timings(derived.operation_log(spark, sf)).select("op_id", r6("duration").alias("duration"))


@query
def method_performance(spark, sf):
    done = audit.method_performance(derived.operation_log(spark, sf))
    return done.select("method", "runs", r6("success_rate").alias("success_rate"), r6("mean_time").alias("mean_time"))


# ---------------------------------------------------------------- Naive Bayes


def labelled(spark, sf) -> DataFrame:
    """Labelled documents with their side of the split, which is made once."""
    samples = derived.labelled(spark, sf)
    flags = written_table(spark, "label_split", sf, lambda: bayes.split(samples.select("doc_id", "label").distinct()))
    return samples.join(flags, ["doc_id", "label"])


def label_model(spark, sf) -> bayes.BayesModel:
    """Model of the quality labels, written once."""
    fresh = cache(lambda: bayes.train(labelled(spark, sf)))
    return bayes.BayesModel(
        written_table(spark, "label_terms", sf, lambda: fresh().terms),
        written_table(spark, "label_priors", sf, lambda: fresh().priors),
    )


def built_in_model(spark, sf) -> bayes.BayesModel:
    fresh = cache(lambda: bayes.train(bayes.built_in_samples(spark)))
    return bayes.BayesModel(
        written_table(spark, "built_in_terms", sf, lambda: fresh().terms),
        written_table(spark, "built_in_priors", sf, lambda: fresh().priors),
    )


@query
def nb_vocabulary(spark, sf):
    samples = bayes.training_part(labelled(spark, sf))
    return bayes.vocabulary(bayes.term_counts(samples), samples).select("term", r6("idf").alias("idf"))


@query
def nb_train(spark, sf):
    return bayes.train(labelled(spark, sf)).terms.select("label", "term", r6("log_prob").alias("log_prob"))


@query
def nb_predict(spark, sf):
    done = bayes.predict(table(spark, sf, "documents"), label_model(spark, sf))
    return done.select("doc_id", "type", r6("confidence").alias("confidence"))


@query
def nb_probabilities(spark, sf):
    done = bayes.probabilities(table(spark, sf, "documents"), label_model(spark, sf))
    return done.select("doc_id", "label", r6("probability").alias("probability"))


@query
def nb_probability_map(spark, sf):
    done = bayes.probability_map(table(spark, sf, "documents"), label_model(spark, sf))
    return done.select(
        "doc_id", r6(F.element_at("probabilities", "0")).alias("p0"), r6(F.element_at("probabilities", "1")).alias("p1")
    )


@query
def nb_predict_business(spark, sf):
    """Business documents under the model of the built-in samples."""
    done = bayes.predict(business_docs(spark, sf), built_in_model(spark, sf))
    return done.select("doc_id", "type", r6("confidence").alias("confidence"))


@query
def nb_top_terms(spark, sf):
    done = bayes.top_terms(label_model(spark, sf))
    return done.select("label", "term", r6("log_prob").alias("log_prob"), big("position").alias("position"))


@query
def nb_accuracy(spark, sf):
    """On the samples that the model was not fitted on."""
    samples = bayes.test_part(labelled(spark, sf))
    done = bayes.accuracy(bayes.predict(samples, label_model(spark, sf)), samples)
    return done.select("samples", r6("accuracy").alias("accuracy"))


@query
def nb_class_counts(spark, sf):
    return bayes.class_counts(derived.labelled(spark, sf))


@query
def nb_split(spark, sf):
    """Which samples are held out."""
    return bayes.split(derived.labelled(spark, sf).select("doc_id", "label"))


@query
def nb_feedback_classes(spark, sf):
    """Training set of the built-in samples and the reviewed documents."""
    c = catalog(spark, sf)
    reviewed = review.latest_overrides(derived.corrections(c))
    return bayes.class_counts(bayes.with_feedback(bayes.built_in_samples(spark), reviewed, c))


@query
def nb_retrained(spark, sf):
    """Model of the built-in samples and the reviewed documents; sample ids are negative to stay apart."""
    c = catalog(spark, sf)
    samples = bayes.built_in_samples(spark).withColumn("doc_id", -1 - F.col("doc_id"))
    reviewed = review.latest_overrides(derived.corrections(c))
    merged = written_table(spark, "feedback_samples", sf, lambda: bayes.split(bayes.with_feedback(samples, reviewed, c)))
    model = bayes.train(merged)
    return model.terms.select("label", "term", r6("log_prob").alias("log_prob"))


# ---------------------------------------------------------------- pages and validation


@query
def assemble_pages(spark, sf):
    return pages.assemble(derived.page_table(spark, sf))


@query
def page_lookup(spark, sf):
    """Third page of every document, where it has one."""
    table_ = derived.page_table(spark, sf)
    requests = table_.select("doc_id").distinct().withColumn("page_index", F.lit(2).cast("bigint"))
    return pages.page_lookup(requests, table_).select("doc_id", "text")


@query
def page_profile(spark, sf):
    p = pages.page_profile(derived.page_table(spark, sf))
    return p.select(
        "doc_id", "total_pages", "pages_with_text", r6("average_text_length").alias("average_text_length"),
        "total_characters", "extractable_pages", "extractable_chars", "has_early_text", r6("text_density").alias("text_density"),
    )


@query
def document_info(spark, sf):
    """Page count with properties that come from another table."""
    table_ = derived.page_table(spark, sf)
    info = table_.groupBy("doc_id").agg(F.min_by("role", "page_num").alias("author")).filter(F.col("author") == "user")
    return pages.document_info(table_, info)


@query
def validate_manifest(spark, sf):
    v = validation.validate(derived.manifest(spark, sf))
    return v.select(
        "doc_id", "stage", "is_valid", "to_quarantine", listed("errors").alias("errors"), listed("warnings").alias("warnings"),
        F.coalesce("security.permissions.print", F.lit(False)).alias("may_print"),
        F.coalesce("security.permissions.copy", F.lit(False)).alias("may_copy"),
    )


@query
def validation_report(spark, sf):
    v = validation.report(derived.manifest(spark, sf))
    return v.select(
        "doc_id", "check_extension", "check_size", "check_structure", "check_content", "is_valid", "size_mb",
        listed("warnings").alias("warnings"),
    )


@query
def validation_totals(spark, sf):
    return validation.totals(validation.report(derived.manifest(spark, sf)))


@query
def validation_errors_by_kind(spark, sf):
    """How often each stage rejects files."""
    v = validation.validate(derived.manifest(spark, sf))
    return v.groupBy("stage", "is_valid").agg(F.count("*").alias("n"))


@query
def quarantine_rows(spark, sf):
    rows = validation.quarantine_rows(validation.validate(derived.manifest(spark, sf)), moment(QUARANTINE_AT))
    return rows.select("path", "quarantine_name", F.get_json_object("report", "$.errors[0]").alias("first_error"))


@query
def quarantine_summary(spark, sf):
    validated = validation.validate(derived.manifest(spark, sf))
    return validation.quarantine_summary(validation.quarantine_rows(validated, moment(QUARANTINE_AT)))


@query
def input_manifest(spark, sf):
    """Files of a folder that may be processed, by the name and size rules."""
    kept = files.supported(derived.manifest(spark, sf))
    return kept.select("doc_id", "path", "length")


@query
def input_status(spark, sf):
    return files.folder_status(files.supported(derived.manifest(spark, sf)))


@query
def input_rejected(spark, sf):
    """Files that are not taken, and why."""
    return files.rejected(derived.manifest(spark, sf)).select("doc_id", "path", "length", "reason")


@query
def input_new(spark, sf):
    """Against an earlier manifest that lacks every fifth file and has another size for every seventh."""
    now = derived.manifest(spark, sf).select("doc_id", "path", "length")
    seen = now.filter(F.col("doc_id") % 5 != 0).withColumn("length", F.col("length") + (F.col("doc_id") % 7 == 0).cast("int"))
    return files.new_files(now, seen)


@query
def content_hashes(spark, sf):
    """Hash and completeness of given bytes; every eleventh file ends early, and those above 5,000 bytes are not read."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    given = table(spark, sf, "pages").select(
        F.concat(F.lit("/in/"), F.col("page_id").cast("string")).alias("path"), body.alias("content"),
        (F.octet_length(body) + (F.col("page_id") % 11 == 0).cast("int")).cast("bigint").alias("length"),
    )
    return files.with_hashes(given, max_bytes=5000)


@query
def validate_profiled(spark, sf):
    """Files judged by the pages found in them, with their properties and what was read of them."""
    table_ = derived.page_table(spark, sf)
    profile = pages.page_profile(table_)
    info = pages.document_info(table_, table_.groupBy("doc_id").agg(F.min_by("role", "page_num").alias("author")))
    given = profile.select(
        "doc_id", F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"),
        (F.col("total_characters") * 8).alias("length"), (F.col("doc_id") % 13 == 0).alias("needs_pass"),
        (F.col("doc_id") % 64).cast("int").alias("permissions"), F.lit(0).alias("pages_with_images"),
        (F.col("total_characters") * 8 - (F.col("doc_id") % 11 == 0).cast("int")).alias("bytes_read"),
    )
    v = validation.validate(validation.with_profile(given, profile, info))
    return v.select(
        "doc_id", "stage", "is_valid", "to_quarantine", listed("errors").alias("errors"), big("page_count").alias("page_count"),
        F.col("properties.author").alias("author"), big("properties.page_count").alias("counted_pages"),
    )


@query
def input_merged(spark, sf):
    """Two overlapping scans of a folder, each file once."""
    m = derived.manifest(spark, sf).select("path", "length")
    lower = m.filter(F.endswith(F.lower("path"), F.lit(".pdf")))
    return files.merged_scans(lower, m.filter(F.endswith("path", F.lit(".PDF"))))


@query
def file_hashes(spark, sf):
    """Hash and completeness of every file in the input folder."""
    scanned = files.with_hashes(files.scan_folder(spark, sf, "*.parquet"))
    return scanned.withColumn("path", F.element_at(F.split("path", "/"), -1))


# ---------------------------------------------------------------- layout


@query
def layout_blocks(spark, sf):
    b = layout.blocks(derived.spans(spark, sf))
    return b.select(
        "doc_id", big("block_id").alias("block_id"), "text", *[r6(c).alias(c) for c in ("x_min", "x_max", "y_min", "y_max")], "zone"
    )


@query
def layout_zones(spark, sf):
    return layout.zones(layout.blocks(derived.spans(spark, sf))).withColumn("share", r6("share"))


@query
def layout_bounds(spark, sf):
    b = layout.bounds(layout.blocks(derived.spans(spark, sf)))
    return b.select("doc_id", *[r6(c).alias(c) for c in b.columns if c != "doc_id"])


@query
def layout_fonts(spark, sf):
    f = layout.fonts(derived.spans(spark, sf))
    return f.select("doc_id", "common_size", "n_sizes", r6("mean_size").alias("mean_size"))


@query
def layout_font_histogram(spark, sf):
    return layout.font_histogram(derived.spans(spark, sf))


@query
def layout_tables(spark, sf):
    return layout.tables(derived.spans(spark, sf))


@query
def layout_titles(spark, sf):
    t = layout.titles(derived.spans(spark, sf))
    return t.select("doc_id", "title", "size", r6("position").alias("position"))


@query
def layout_scores(spark, sf):
    s = layout.layout_scores(derived.spans(spark, sf))
    return s.select(
        "doc_id", *[r6(c).alias(c) for c in s.columns if c.startswith("score_")],
        F.col("layout.type").alias("best_match"), r6("layout.confidence").alias("confidence"),
    )


# ---------------------------------------------------------------- exports


@query
def export_flat(spark, sf):
    flat = exports.flat(catalog(spark, sf), classify.RULE_METHODS)
    return flat.select(
        "id", "tipo", *[c for m in classify.RULE_METHODS for c in (f"method_{m}_type",)],
        *[r6(f"method_{m}_confidence").alias(f"method_{m}_confidence") for m in classify.RULE_METHODS],
        "consensus_best", "consensus_strong",
    )


@query
def export_methods_long(spark, sf):
    return exports.methods_long(catalog(spark, sf)).select(
        "documento_id", "metodo", "tipo_predicho", r6("confianza").alias("confianza"), "tipo_final"
    )


@query
def export_filtered(spark, sf):
    """Filters of an export; the zero confidence means no filter."""
    kept = catalog(spark, sf).filter(cat.export_filter({
        "document_type": "facturas", "min_confidence": 0, "supplier_id": "edesur", "date_from": "1996-01-01",
    }))
    return kept.select("id", "filename", "monto")


def _exported(spark, sf, fmt: str) -> str:
    path = new_path(spark, f"export-{fmt}")
    exports.export(spark, catalog(spark, sf), path, fmt, as_of=AS_OF)
    return f"{path}/records"


@query
def export_csv_roundtrip(spark, sf):
    back = spark.read.csv(_exported(spark, sf, "csv"), header=True)
    back = back.withColumnRenamed(back.columns[0], back.columns[0].lstrip(exports.BOM))
    return back.select(F.col("id").cast("bigint").alias("id"), "tipo", "method_keyword_type", "monto")


@query
def export_json_roundtrip(spark, sf):
    schema = f"id bigint, tipo string, monto string, detalles_clasificacion {cat.DETAILS}"
    back = spark.read.schema(schema).json(_exported(spark, sf, "json"))
    return back.select("id", "tipo", "monto", "detalles_clasificacion.consensus.best_consensus")


@query
def export_xml_roundtrip(spark, sf):
    schema = (
        "id bigint, tipo string, monto string, classification_details struct<methods:struct<method:"
        "array<struct<_name:string,type:string,confidence:double>>>>"
    )
    back = spark.read.schema(schema).format("xml").option("rowTag", "document").load(_exported(spark, sf, "xml"))
    methods = F.col("classification_details.methods.method")
    return back.select("id", "tipo", "monto", big(F.size(methods)).alias("n_methods"))


@query
def export_metadata(spark, sf):
    """Row count that the export observed while it wrote."""
    path = new_path(spark, "export-meta")
    return exports.export(spark, catalog(spark, sf), path, "json", {"document_type": "remitos"}, AS_OF).select(
        "export_date", "total_records", "format", "version", "success"
    )


@query
def export_searched(spark, sf):
    """An export with the filters of a search."""
    path = new_path(spark, "export-searched")
    wanted = cat.search_filter(proveedor="EDESUR", tipo="facturas", monto_min=50000)
    exports.export(spark, catalog(spark, sf), path, "json", as_of=AS_OF, condition=wanted)
    return spark.read.schema("id bigint, tipo string, monto string").json(f"{path}/records")


@query
def catalog_appended(spark, sf):
    """The whole catalog appended to a folder in two batches."""
    path = new_path(spark, "appended")
    rows = catalog(spark, sf)
    for half in (0, 1):
        cat.append_catalog(rows.filter(F.col("id") % 2 == half), path)
    return spark.read.parquet(path).groupBy("tipo").agg(F.count("*").alias("n"), r6(F.avg("confidence")).alias("avg_confidence"))


@query
def catalog_created(spark, sf):
    """The catalog as a table of the session: created, created again, and filled."""
    path = new_path(spark, "created")
    name = "documentos_" + path.rsplit("-", 1)[1]
    for _ in range(2):
        cat.create_catalog(spark, name, path)
    rows = catalog(spark, sf)
    rows.select(*spark.table(name).columns).hint("rebalance", "tipo").write.insertInto(name)
    return spark.table(name).groupBy("tipo").agg(F.count("*").alias("n"), F.count("cuit").alias("with_cuit"), F.max("doc_date").alias("latest"))


@query
def review_merged(spark, sf):
    """Corrections merged into a stored catalog, of which only the types they touch are written anew."""
    path = new_path(spark, "versions")
    rows = catalog(spark, sf).select("id", "filename", "tipo", "confidence", "doc_date", "amount", "fecha_procesado")
    versions.write_version(rows, path)
    versions.merge_overrides(spark, path, rows.schema, derived.corrections(rows))
    return versions.read_version(spark, path, rows.schema).select("id", "filename", "tipo")


@query
def catalog_search_clustered(spark, sf):
    """A few days of one type, from files that are sorted by day within it."""
    path = new_path(spark, "clustered")
    rows = catalog(spark, sf).drop("detalles_clasificacion", "texto_extraido", "metodos_usados")
    versions.write_version(rows, path)
    stored = versions.read_version(spark, path, rows.schema, types=["facturas"])
    return _shown(stored.filter(cat.search_filter(tipo="facturas", fecha_desde="1996-03-01", fecha_hasta="1996-03-20")))


@query
def export_several(spark, sf):
    """The same searched rows in three formats, read back and counted."""
    path = new_path(spark, "several")
    wanted = cat.search_filter(proveedor="TELECOM", confidence_min=0.2)
    done = exports.export_many(spark, catalog(spark, sf), path, ("csv", "json", "xml"), condition=wanted)
    total = None
    for fmt, meta in done.items():
        # a schema, as finding one reads and parses every record before the count does
        records = spark.read.schema("id bigint").format(fmt).options(rowTag="document", header="true").load(f"{path}/{fmt}/records")
        one = meta.select("format", "total_records", records.agg(F.count("*")).scalar().alias("read"))
        total = one if total is None else total.unionByName(one)
    return total


@query
def registry_json(spark, sf):
    """The registry as JSON, read back with its patterns."""
    path = new_path(spark, "registry-lines")
    base = derived.supplier_registry(spark, sf)
    pattern = F.struct(F.array(F.upper(F.element_at("names", 1))).alias("specific_terms"), F.array(F.lit("TOTAL")).alias("layout_indicators"), F.lit(0.25).alias("confidence_boost"))
    write_registry_lines(base.withColumn("document_patterns", F.create_map(F.lit("facturas"), pattern)), path)
    back = read_registry_lines(spark, path)
    flat = registry_patterns(back).select("supplier_id", "doc_type", listed("specific_terms").alias("terms"), "confidence_boost")
    return back.select("supplier_id", big("ord").alias("ord"), listed("names").alias("name"), "cuit").join(flat, "supplier_id")


@query
def registry_saved(spark, sf):
    """The registry written and read back."""
    path = new_path(spark, "registry")
    write_registry(derived.supplier_registry(spark, sf), path)
    return spark.read.parquet(path).select("supplier_id", F.element_at("names", 1).alias("name"), "cuit")


@query
def nb_model_saved(spark, sf):
    """Most likely terms of a model saved and loaded."""
    path = new_path(spark, "model")
    bayes.save_model(label_model(spark, sf), path)
    done = bayes.top_terms(bayes.load_model(spark, path))
    return done.select("label", "term", r6("log_prob").alias("log_prob"), big("position").alias("position"))


# ---------------------------------------------------------------- streaming


def _streamed(spark, sf) -> str:
    """Folder to which all document files went through the stream, twice; the second run finds nothing new."""
    source, target = new_path(spark, "inbox"), new_path(spark, "ingested")
    business_docs(spark, sf).write.parquet(source)
    for _ in range(2):
        streaming.ingest(
            spark, source, target, f"{target}/state", derived.manifest(spark, sf), moment(QUARANTINE_AT)
        ).awaitTermination()
    return target


@query
def stream_ingest(spark, sf):
    """The results of the stream are those of the batch."""
    return spark.read.parquet(f"{_streamed(spark, sf)}/results").select(
        "doc_id", "success", "error", "classification", r6("confidence").alias("confidence"), "destination"
    )


@query
def stream_quarantine(spark, sf):
    rows = spark.read.parquet(f"{_streamed(spark, sf)}/quarantine")
    return rows.select("path", "quarantine_name", F.get_json_object("report", "$.errors[0]").alias("first_error"))


@query
def stream_recent(spark, sf):
    """Events of the last 24 hours at every sixth hour, from a stream that gets some of them twice and some others
    weeks too late: neither counts."""
    source, target, state = new_path(spark, "recent-events"), new_path(spark, "recent"), new_path(spark, "recent-state")
    utc = F.concat(F.col("ts").cast("timestamp_ntz").cast("string"), F.lit("Z")).cast("timestamp")
    events = table(spark, sf, "events").select("event_id", utc.alias("ts"), "event_type")
    newest = events.agg(F.max("ts")).scalar()
    again = events.filter((F.col("ts") > newest - F.expr("INTERVAL 1 DAY")) & (F.col("event_id") % 2 == 0))
    late = events.filter(F.col("ts") < newest - F.expr("INTERVAL 14 DAYS")).withColumn("event_id", -1 - F.col("event_id"))
    for arriving in (events, again, late):
        arriving.write.mode("append").parquet(source)
        stream = spark.readStream.schema("event_id bigint, ts timestamp, event_type string").parquet(source)
        streaming.recent_counts(stream, "ts", "event_id", "event_type").writeStream.outputMode("update").foreachBatch(
            lambda df, i: df.write.mode("overwrite").parquet(f"{target}/batch_id={i}")
        ).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    done = streaming.latest_counts(spark.read.parquet(target), "event_type", "until")
    return done.select(F.unix_seconds("until").alias("until_s"), "event_type", "n")


@query
def recent_windows(spark, sf):
    """The same windows over the table as a whole."""
    utc = F.concat(F.col("ts").cast("timestamp_ntz").cast("string"), F.lit("Z")).cast("timestamp")
    events = table(spark, sf, "events").select("event_id", utc.alias("ts"), "event_type")
    done = streaming.recent_counts(events.unionAll(events.filter("event_id % 3 = 0")), "ts", "event_id", "event_type")
    return done.select(F.unix_seconds("until").alias("until_s"), "event_type", "n")


@query
def stream_daily_counts(spark, sf):
    """Daily counts per event type on the stream, in update mode: the watermark drops the state of past days."""
    source, target = new_path(spark, "events"), new_path(spark, "daily")
    utc = F.concat(F.col("ts").cast("timestamp_ntz").cast("string"), F.lit("Z")).cast("timestamp")
    table(spark, sf, "events").select(utc.alias("ts"), "event_type").write.parquet(source)
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(source)
    run = streaming.daily_counts(stream, "ts", "event_type").writeStream.outputMode("update").foreachBatch(
        lambda df, i: df.write.mode("overwrite").parquet(f"{target}/batch_id={i}")
    ).option("checkpointLocation", new_path(spark, "daily-state")).trigger(availableNow=True).start()
    run.awaitTermination()
    day = F.date_from_unix_date(F.floor(F.unix_seconds("day") / 86400).cast("int"))
    return streaming.latest_counts(spark.read.parquet(target), "event_type").select(day.alias("day"), "event_type", "n")
