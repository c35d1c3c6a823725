import datetime as dt
import json
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from legajo.functions import metadata as md
from legajo.operators import bayes, consensus, layout, pages, review, suppliers, validation
from legajo.operators import catalog as cat
from legajo.plans import batch
from legajo.rules import metadata as rules
from legajo.rules import training
from legajo.session import new_path, shared_folder, written_table
from legajo.sources import exports, files, registry, versions
from legajo.sources.tables import business_docs
from legajo.streaming import ingest


def one(df):
    return df.collect()[0]


@pytest.mark.parametrize("raw, strict, normal", [
    ("$5.000", "5.00", "5000.00"), ("$ 1,234.50", None, "1234.50"), ("$", None, None), ("$25.800.00", None, None),
    ("$1.500,00", None, "1500.00"), ("$ 85,500", "85.50", "85500.00"), ("$12,5", "12.50", "12.50"), (None, None, None),
])
def test_amounts(spark, raw, strict, normal):
    row = one(spark.createDataFrame([(raw,)], "m string").select(
        md.strict_amount(F.col("m")).alias("s"), md.normalized_amount(F.col("m")).alias("n")))
    assert (row.s and str(row.s), row.n and str(row.n)) == (strict, normal)


@pytest.mark.parametrize("raw, day", [
    ("31/02/2024", None), ("1-2-2024", "2024-02-01"), ("2024/9/5", "2024-09-05"), ("15 de marzo de 2024", "2024-03-15"),
    ("15 de Brumario de 2024", None), ("30/09/2024", "2024-09-30"), (None, None),
])
def test_dates(spark, raw, day):
    got = one(spark.createDataFrame([(raw,)], "d string").select(md.parsed_date(F.col("d")).alias("d"))).d
    assert (got and got.isoformat()) == day


def test_metadata(spark):
    text = (
        "Primera línea\n  Proveedor: ACME Servicios S.A.\nCUIT: 30-12345678-9\nFecha 15/09/2024 y 15/09/2024, 2024-10-01, "
        "3 de octubre de 2024\nNúmero: 55-12 Factura N° 77 Total $ 1,250.50 y $5.000,00"
    )
    m = one(spark.createDataFrame([(text,)], "t string").select(md.metadata(F.col("t"), F.current_timestamp()).alias("m"))).m
    assert m.cuit == "30-12345678-9" and m.document_number == "55-12"
    assert m.dates == ["15/09/2024", "2024-10-01", "3 de octubre de 2024"]
    assert m.amounts == re.findall(rules.AMOUNT, text) == ["$ 1,250.50", "$5.000"]
    assert m.supplier == "ACME Servicios S.A."


def test_supplier_fields_absent(spark):
    row = one(spark.createDataFrame([("TELÉFONO: 4555-1234 00 DOMICILIO: Av. Siempreviva 742",)], "t string").select(
        md.supplier_fields(F.col("t")).alias("f")))
    assert set(row.f) == {"teléfono", "domicilio"}


def test_registry_roundtrip_and_search(spark):
    reg = registry.built_in_registry(spark)
    path = new_path(spark, "registry")
    registry.write_registry(reg, path)
    assert spark.read.parquet(path).count() == 5
    body = {r.supplier_id: {"names": r.names, "cuit": r.cuit, "document_patterns": {
        k: v.asDict() for k, v in r.document_patterns.items()}} for r in reg.orderBy("ord").collect()}
    text_path = new_path(spark, "registry-json")
    spark.createDataFrame([(json.dumps(body),)], "value string").coalesce(1).write.text(text_path)
    back = registry.read_registry(spark, text_path)
    assert [r.supplier_id for r in back.orderBy("ord").collect()] == list(body)
    assert [r.supplier_id for r in suppliers.search_suppliers(back, "30-5").collect()] == ["telecom_argentina", "andreani"]


def test_supplier_detection_by_join_and_by_columns(spark):
    pattern = {"facturas": (["TERM ONE", "X", "zz"], ["Indicator"], 0.1), "recibos": (["other"], None, 0.2)}
    rows = [
        (0, "a", ["Alpha Beta Gamma", "AB"], "30-1", pattern, None), (1, "b", ["Alpha Beta Gamma"], None, None, None), (2, "c", None, "30-12", pattern, None),
        (3, "d", ["Ñandú"], "", {"facturas": ([], [], 0.1)}, None), (4, "e", [], None, {"remitos": (["term one", "term two"], ["30-1"], 0.1)}, None),
    ]
    reg = spark.createDataFrame(rows, registry.SCHEMA)
    texts_ = ["", None, "alpha BETA gamma", "gamma then alpha", "30-12", "term one x zz indicator", "ñandú", "x", "ab 30-1 other", "term one term two 30-1", "nothing\nhere"]
    docs = spark.createDataFrame(list(enumerate(texts_)), "doc_id int, text string")
    joined = suppliers.detect_supplier(docs, reg)
    compiled = suppliers.detect_supplier(docs, reg.orderBy("ord").collect())
    key = lambda r: (r.doc_id, r.supplier_id, round(r.supplier_confidence, 9))
    assert sorted(map(key, joined.collect())) == sorted(map(key, compiled.collect()))
    assert {r.doc_id: r.supplier_id for r in joined.collect()}[2] == "a"
    assert joined.filter("supplier_id is not null").count() >= 4


def test_terms_that_begin_alike_spread_over_postings(spark):
    """A hundred thousand names with a common beginning: a text meets those that share its rarest grams only."""
    names = spark.range(100_000).select(F.format_string("SUPPLIER#%09d", F.col("id") * 7919 % 1_000_003).alias("term"))
    index = suppliers.term_index(names)
    assert index.count() == 100_000 and index.groupBy("gram").count().agg(F.max("count")).first()[0] <= 16 * 13
    wanted = [r.term for r in names.limit(5).collect()]
    texts_ = [f"pago a {t.lower()} y otros 🙂 {t}x" for t in wanted] + ["SUPPLIER# sin número", "nada", None, "SUPPLIER#" * 50]
    docs = spark.createDataFrame(list(enumerate(texts_)), "doc_id int, text string")
    found = suppliers.term_candidates(docs, index)
    assert found.count() <= 200 * len(texts_)
    hits = found.filter(F.contains("around", F.col("term"))).select("doc_id", "term").distinct().collect()
    assert sorted((r.doc_id, r.term) for r in hits) == list(enumerate(wanted))


def test_in_row_decision_agrees_with_grouped_consensus(spark, sf):
    from legajo.queries import votes
    voted = votes(spark, sf)
    methods = ("keyword", "regex", "agro", "commercial")
    row_wise = consensus.decide(voted, methods, registry.registry_patterns(registry.built_in_registry(spark))).select(
        "doc_id", "consensus.best_consensus", "consensus.has_strong_consensus")
    grouped = consensus.best_consensus(consensus.consensus_stats(consensus.votes_long(voted, methods)))
    joined = row_wise.join(grouped.select("doc_id", F.col("best_consensus").alias("b"), F.col("has_strong_consensus").alias("s")), "doc_id")
    assert joined.count() == voted.count()
    assert joined.filter((F.col("b") != F.col("best_consensus")) | (F.col("s") != F.col("has_strong_consensus"))).isEmpty()


def test_thresholds_of_decision(spark):
    def decide(keyword, agro, commercial=("desconocido", 0.0)):
        df = spark.createDataFrame(
            [(1, None, keyword, ("desconocido", 0.0), agro, commercial)],
            "doc_id int, supplier_id string, keyword struct<type:string,confidence:double>, regex struct<type:string,confidence:double>, "
            "agro struct<type:string,confidence:double>, commercial struct<type:string,confidence:double>")
        boosts = registry.registry_patterns(registry.built_in_registry(spark))
        return one(consensus.decide(df, ("keyword", "regex", "agro", "commercial"), boosts))

    assert decide(("facturas", 1.0), ("desconocido", 0.0)).tipo == "facturas"  # 0.15 is enough
    assert decide(("facturas", 0.99), ("desconocido", 0.0)).tipo == "desconocido"
    shortcut = decide(("facturas", 1.0), ("cot", 0.9), ("cheques", 1.0))
    assert shortcut.tipo == "cot" and shortcut.confidence == pytest.approx(0.525)
    strong = decide(("pesajes", 0.8), ("pesajes", 0.8))
    assert strong.consensus.has_strong_consensus and strong.confidence == pytest.approx(0.8 * 0.4 + 0.1)
    assert strong.decision.reasoning.startswith("Métodos coincidentes: keyword (0.80), agro (0.80) | Consenso fuerte: 2")
    assert decide(("pesajes", 0.1), ("pesajes", 0.8)).consensus.total_methods == 1  # 0.1 does not vote


def test_bayes_against_dense_arithmetic(spark):
    samples = bayes.built_in_samples(spark)
    model = bayes.train(samples)
    rows = samples.orderBy("doc_id").collect()
    stop = set(training.STOP_WORDS)

    def grams(text):
        words = [w for w in re.findall(r"\b\w\w+\b", text.lower()) if w not in stop]
        return words + [" ".join(p) for p in zip(words, words[1:])]

    counts = [grams(r.text) for r in rows]
    df = {t: sum(t in c for c in counts) for t in {t for c in counts for t in c}}
    vocab = sorted(t for t, n in df.items() if 2 <= n <= 0.8 * len(rows))
    idf = np.array([np.log((1 + len(rows)) / (1 + df[t])) + 1 for t in vocab])
    x = np.array([[c.count(t) for t in vocab] for c in counts]) * idf
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels = sorted({r.label for r in rows})
    logp, prior = [], []
    for name in labels:
        mine = [i for i, r in enumerate(rows) if r.label == name]
        s = x[mine].sum(axis=0) + 1
        logp.append(np.log(s) - np.log(s.sum()))
        prior.append(np.log(len(mine) / len(rows)))
    score = x @ np.array(logp).T + np.array(prior)
    p = np.exp(score - score.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    got = {r.doc_id: r for r in bayes.predict(samples, model).collect()}
    for i, r in enumerate(rows):
        assert got[r.doc_id].confidence == pytest.approx(p[i].max(), abs=1e-9)
        assert got[r.doc_id].type == labels[int(p[i].argmax())]
    unknown = one(bayes.predict(spark.createDataFrame([(9, "zzz")], "doc_id bigint, text string"), model))
    assert unknown.type == labels[0] and unknown.confidence == pytest.approx(1 / 6)
    path = new_path(spark, "model")
    bayes.save_model(model, path)
    assert bayes.load_model(spark, path).terms.count() == len(vocab) * len(labels)


def test_split_is_exact_and_small_sets_are_not_split(spark):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("label"))
    sizes = {r.label: (r.n, r.t) for r in bayes.split(rows).groupBy("label").agg(
        F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert sizes == {"a": (667, 133), "b": (1333, 267)}
    assert bayes.split(rows.limit(10)).filter("is_test is not null").isEmpty()


def test_pages(spark):
    rows = [(1, 2, " dos "), (1, 1, "uno\n"), (2, 1, None), (1, 3, "  ")]
    table = spark.createDataFrame(rows, "doc_id bigint, page_num bigint, text string")
    text = {r.doc_id: r.text for r in pages.assemble(table).collect()}
    assert text[1] == "--- Página 1 ---\nuno\n\n--- Página 2 ---\n dos \n--- Página 3 ---" and text[2] == "--- Página 1 ---"
    asked = spark.createDataFrame([(1, 1), (1, 9)], "doc_id bigint, page_index bigint")
    assert {(r.page_index, r.text) for r in pages.page_lookup(asked, table).collect()} == {(1, "dos"), (9, None)}
    profile = {r.doc_id: r for r in pages.page_profile(table).collect()}
    assert (profile[1].total_pages, profile[1].pages_with_text, profile[1].total_characters) == (3, 2, 9)
    assert profile[2].extractable_pages == 0 and profile[2].average_text_length == 0


def test_validation_limits(spark):
    base = dict(page_count=1, needs_pass=False, permissions=20, pages_with_images=0, total_characters=100, extractable_chars=100, has_early_text=True)
    cases = {
        "a.pdf": (dict(length=1024), True, "complete"), "b.pdf": (dict(length=1023), False, "basic"),
        "c.PDF": (dict(length=50 * 2**20), True, "complete"), "d.pdf": (dict(length=50 * 2**20 + 1), False, "basic"),
        "e.txt": (dict(length=5000), False, "basic"), "f.pdf": (dict(length=5000, page_count=0), False, "structure"),
        "g.pdf": (dict(length=5000, page_count=500), True, "complete"), "h.pdf": (dict(length=5000, page_count=501), False, "structure"),
        "i.pdf": (dict(length=5000, needs_pass=True), False, "complete"),
        "j.pdf": (dict(length=5000, total_characters=9), False, "complete"),
        "k.pdf": (dict(length=5000, total_characters=9, pages_with_images=1), True, "complete"),
    }
    rows = [dict(base, path=f"/in/{n}", **c) for n, (c, _, _) in cases.items()]
    schema = ("path string, length bigint, page_count int, needs_pass boolean, permissions int, pages_with_images int, "
              "total_characters bigint, extractable_chars bigint, has_early_text boolean")
    checked = {r.path[4:]: r for r in validation.validate(spark.createDataFrame(rows, schema)).collect()}
    for name, (_, valid, stage) in cases.items():
        assert (checked[name].is_valid, checked[name].stage) == (valid, stage), name
    assert {n for n, r in checked.items() if r.to_quarantine} == {"i.pdf", "j.pdf"}
    assert checked["k.pdf"].warnings and checked["a.pdf"].security.permissions.copy and not checked["a.pdf"].security.permissions.modify


def span(doc, block, line, i, text, size=10.0, x0=40.0, y0=40.0):
    return (doc, 600.0, 800.0, block, line, i, text, size, "F", x0, y0, x0 + 6 * len(text), y0 + 14)


def test_layout(spark):
    schema = ("doc_id bigint, page_w double, page_h double, block_id int, line_id int, span_id int, text string, size double, "
              "font string, x0 double, y0 double, x1 double, y1 double")
    rows = [span(1, 0, 0, 0, "FACTURA N", 16.0), span(1, 0, 0, 1, "0001")]
    for b in (1, 2):
        rows += [span(1, b, n, 0, f"fila {n}", y0=300.0 + 100 * b + 15 * n) for n in range(4)]
    rows += [span(1, 3, 0, 0, "IVA pie", y0=760.0)]
    spans = spark.createDataFrame(rows, schema)
    first = {r.block_id: r for r in layout.blocks(spans).collect()}
    assert first[0].text == "FACTURA N 0001" and first[0].zone == "header" and first[3].zone == "footer"
    table = one(layout.tables(spans))
    assert (table.aligned_blocks, table.has_table) == (2, True)
    font = one(layout.fonts(spans))
    assert (font.common_size, font.n_sizes) == (10.0, 2)
    assert [r.title for r in layout.titles(spans).collect()] == ["FACTURA N"]
    scores = one(layout.layout_scores(spans))
    # title 1, table 1, size 1, margins 0.5 for the sides, 0 for the ends (top margin is exactly 5%), tax 0.5
    assert scores.layout.type == "facturas" and scores.layout.confidence == pytest.approx(4.0 / 5)


def test_nested_layout_agrees_with_its_parts(spark):
    """Several spans a line and lines a block: the one-row analysis against the separate groupings."""
    import random
    rnd = random.Random(5)
    words = ["FACTURA B", "código", "descripción", "Total", "x", " nota 12 ", "IVA", "precio", "RECIBO OFICIAL", "línea"]
    rows = [
        span(d, b, n, i, rnd.choice(words), rnd.choice([8.0, 10.0, 10.0, 14.0]), rnd.choice([40.0, 60.0, 90.0]), 40.0 + 60 * b + 12 * n)
        for d in range(12) for b in range(rnd.randrange(1, 9)) for n in range(rnd.randrange(1, 6)) for i in range(rnd.randrange(1, 4))
    ]
    schema = ("doc_id bigint, page_w double, page_h double, block_id int, line_id int, span_id int, text string, size double, "
              "font string, x0 double, y0 double, x1 double, y1 double")
    spans = spark.createDataFrame(rows, schema).repartition(6)
    got = {r.doc_id: r for r in layout.analysis(spans).collect()}
    assert len(got) == 12 and any(r.has_table for r in got.values()) and any(r.titles for r in got.values())
    laid = layout.blocks(spans)
    for part in (layout.bounds(laid), layout.fonts(spans), layout.tables(spans)):
        for r in part.collect():
            for name, value in r.asDict().items():
                assert got[r.doc_id][name] == (pytest.approx(value) if isinstance(value, float) else value), name
    for d, r in got.items():
        mine = laid.filter(F.col("doc_id") == d).orderBy("block_id").collect()
        assert r.total_blocks == len(mine) and r.full_text == " ".join(b.text.lower() for b in mine)
        named = layout.titles(spans.filter(F.col("doc_id") == d)).collect()
        assert sorted(r.titles) == sorted(t.title.lower() for t in named)
    plan = layout.layout_scores(spans)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_review_last_valid_override_wins(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(1, "facturas", day), (1, "remitos", day + dt.timedelta(1)), (1, "nope", day + dt.timedelta(2)), (2, "nope", day)]
    last = review.latest_overrides(spark.createDataFrame(rows, "doc_id bigint, tipo string, ts timestamp_ntz"))
    assert [(r.doc_id, r.tipo) for r in last.collect()] == [(1, "remitos")]


def test_merge_rewrites_only_touched_types(spark, tmp_path):
    path, day = str(tmp_path / "store"), dt.datetime(2024, 1, 1)
    kinds = ["facturas", "remitos", "recibos", "desconocido"]
    rows = spark.createDataFrame([(i, kinds[i % 4], dt.date(2024, 1, 1 + i % 28), float(i)) for i in range(400)], "id bigint, tipo string, doc_date date, amount double")
    assert versions.write_version(rows, path) == 1 and versions.current_parts(spark, path).keys() == set(kinds)
    fixes = [(3, "remitos", day), (7, "facturas", day), (7, "otros", day + dt.timedelta(1)), (1, "remitos", day), (9999, "facturas", day), (2, "unknown kind", day)]
    before = versions.current_parts(spark, path)
    assert versions.merge_overrides(spark, path, rows.schema, spark.createDataFrame(fixes, "doc_id bigint, tipo string, ts timestamp_ntz")) == 2
    after = versions.current_parts(spark, path)
    assert {t for t in after if after[t] != before.get(t)} == {"desconocido", "remitos", "otros"}  # facturas and recibos keep their files
    want = {r.id: r.tipo for r in rows.collect()} | {3: "remitos", 7: "otros"}
    assert {r.id: r.tipo for r in versions.read_version(spark, path, rows.schema).collect()} == want
    assert versions.read_version(spark, path, rows.schema, version=1).filter("id = 3").first().tipo == "desconocido"
    assert versions.merge_overrides(spark, path, rows.schema, spark.createDataFrame(fixes[3:4], "doc_id bigint, tipo string, ts timestamp_ntz")) == 2
    everything = spark.createDataFrame([(i, "facturas", day) for i in range(2, 400, 4)], "doc_id bigint, tipo string, ts timestamp_ntz")
    versions.merge_overrides(spark, path, rows.schema, everything)
    assert versions.read_version(spark, path, rows.schema, types=["recibos"]).collect() == []
    empty = str(tmp_path / "none")
    assert versions.write_version(rows.limit(0), empty) == 1 and versions.read_version(spark, empty, rows.schema).collect() == []


def test_one_day_is_one_stretch_of_a_file(spark, tmp_path):
    """A day of a type lies in few files, and the filter on it reaches them."""
    path = str(tmp_path / "clustered")
    rows = spark.range(20_000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "remitos").otherwise("facturas").alias("tipo"),
        F.date_add(F.lit(dt.date(2020, 1, 1)), (F.col("id") * 7919 % 700).cast("int")).alias("doc_date"), (F.col("id") % 97).cast("double").alias("amount"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as many files as a large table has
    try:
        versions.write_version(rows.repartition(8), path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    day = versions.read_version(spark, path, rows.schema).filter((F.col("tipo") == "facturas") & (F.col("doc_date") == dt.date(2020, 6, 1)))
    every = versions.read_version(spark, path, rows.schema).select(F.input_file_name().alias("f")).distinct().count()
    held = day.select(F.input_file_name().alias("f")).distinct().count()
    assert every > 4 and 1 <= held <= 2 and day.count() == rows.filter((F.col("tipo") == "facturas") & (F.col("doc_date") == dt.date(2020, 6, 1))).count()
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_date" in plan and "PartitionFilters" in plan


def test_folders(spark, tmp_path):
    assert files.scan_folder(spark, str(tmp_path / "missing")).collect() == [] and not files.folder_exists(spark, str(tmp_path / "missing"))
    status = one(files.folder_status(files.scan_folder(spark, str(tmp_path / "missing")), files.folder_exists(spark, str(tmp_path / "missing"))))
    assert (status.files, status.bytes, status.exists) == (0, 0, False)
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.pdf").write_bytes(b"x" * 10)
    (tmp_path / "in" / "deep" / "b.PDF").write_bytes(b"y" * 3000)
    (tmp_path / "in" / "deep" / "c.txt").write_bytes(b"z")
    flat = files.scan_folder(spark, str(tmp_path / "in"))
    deep = files.scan_folder(spark, str(tmp_path / "in"), recursive=True)
    assert flat.count() == 1 and deep.count() == 3 and one(files.folder_status(deep)).exists
    assert {(r.path[-5:], r.reason) for r in files.rejected(deep, max_bytes=100).collect()} == {("b.PDF", "size"), ("c.txt", "extension")}
    hashes = {r.path[-5:]: (r.sha256 is None, r.complete) for r in files.with_hashes(deep, max_bytes=100).collect()}
    assert hashes == {"a.pdf": (False, True), "b.PDF": (True, False), "c.txt": (False, True)}
    seen = files.supported(deep).select("path", "length", "modificationTime")
    assert [r.path[-5:] for r in files.new_files(deep, seen).collect()] == ["c.txt"]


def test_route_gives_unique_paths(spark):
    day = dt.datetime(2024, 1, 1, 10)
    rows = [(i, "a.pdf", "facturas", day + dt.timedelta(hours=i // 2)) for i in range(6)] + [(9, "b.pdf", "facturas", day)]
    docs = spark.createDataFrame(rows, "doc_id bigint, filename string, tipo string, processed_at timestamp_ntz")
    got = {r.doc_id: r.dest_path for r in cat.route(docs, "out").collect()}
    assert len(set(got.values())) == 7
    assert got[0] == "out/facturas/a.pdf" and got[2] == "out/facturas/a_20240101_110000.pdf" and got[9] == "out/facturas/b.pdf"


def test_route_moves_only_what_collides(spark):
    """Half of all rows want one path; the rest keep theirs without an exchange."""
    day = dt.datetime(2024, 1, 1, 10)
    rows = [(i, "hot.pdf" if i % 2 else f"{i}.pdf", "facturas", day + dt.timedelta(seconds=i // 8)) for i in range(400)] + [(None, None, None, None), (401, "x", None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, filename string, tipo string, processed_at timestamp_ntz")
    routed = cat.route(docs, "out")
    got = [(r.doc_id, r.dest_path) for r in routed.collect()]
    assert len(got) == 402 and len({p for _, p in got}) == 402
    paths = dict(got)
    assert paths[1] == "out/facturas/hot.pdf" and paths[2] == "out/facturas/2.pdf" and paths[3] == "out/facturas/hot_20240101_100000_3.pdf"
    assert paths[9] == "out/facturas/hot_20240101_100001.pdf" and paths[11] == "out/facturas/hot_20240101_100001_11.pdf"
    plan = routed._jdf.queryExecution().optimizedPlan().toString()
    # of the first branch those nodes that do not belong to the subquery with the set of bits
    branch = plan.split("\n+- ", 1)[0].split(":- ", 1)[1]
    nodes = re.findall(r"^(?::\s+\+- )?(\w+)", branch, re.M)
    assert nodes[0] == "Project" and "Filter" in nodes and not {"Join", "Aggregate", "Sort"} & set(nodes)


def test_search_by_grams_equals_the_scan(spark, tmp_path):
    import random
    rnd = random.Random(2)
    rows = [(i * 31, rnd.choice([None, "", "ab", "30-" + str(rnd.randrange(10**6)), "ACME Ñandú S.A.", "a🙂bcd"]), f"30-{i:06d}") for i in range(3000)]
    rows += [(-7, "ACME Ñandú S.A.", "30-7"), (-70_000, "Ñandú", None)]
    c = spark.createDataFrame(rows, "id bigint, proveedor string, cuit string")
    path = str(tmp_path / "index")
    cat.write_search_index(c, path)
    index = spark.read.parquet(path)
    for parts in ({"proveedor": "Ñan"}, {"proveedor": "30-12"}, {"cuit": "30-0"}, {"cuit": "0012", "proveedor": "S.A."}, {"proveedor": "🙂bc"}, {"proveedor": "ab"}, {"cuit": "zzz"}):
        want = {i for i, p, t in rows if all(v in ({"proveedor": p, "cuit": t}[k] or "") for k, v in parts.items())}
        assert {r.id for r in cat.search_indexed(c, index, F.lit(True), **parts).collect()} == want, parts
    assert cat.search_candidates(index, "proveedor", "Ñandú").count() == sum("Ñandú" in (p or "") for _, p, _ in rows)


def test_many_candidates_are_not_gathered(spark, tmp_path, monkeypatch):
    """Ids made of bitmaps meet the catalog by a shuffle: the small size of their files must not make a broadcast of them."""
    monkeypatch.setattr(cat, "NAMED_IDS", 5)
    c = spark.range(1, 2001).select("id", F.concat(F.lit("ACME "), F.col("id") % 7).alias("proveedor"), F.concat(F.lit("30-"), F.col("id") % 3).alias("cuit"))
    path = str(tmp_path / "index")
    cat.write_search_index(c, path)
    found = cat.search_indexed(c, spark.read.parquet(path), F.lit(True), proveedor="E 3", cuit="0-2")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id for r in found.collect()) == [i for i in range(1, 2001) if i % 7 == 3 and i % 3 == 2]


def test_pages_by_seeking(spark, tmp_path):
    from legajo.queries import SHOWN
    rows = [(i, None if i % 7 == 0 else i % 5 / 10) for i in range(300)]  # few distinct values, some null
    shell = spark.createDataFrame([], cat.SCHEMA)
    c = shell.unionByName(spark.createDataFrame(rows, "id bigint, confidence double"), allowMissingColumns=True)
    for descending in (True, False):
        path = str(tmp_path / f"order-{descending}")
        cat.write_order(c, path, "confidence", descending, ranges=6)
        order = cat.read_order(spark, path, "confidence", descending)
        assert order.directory.count() > 1
        want = [r.id for r in c.orderBy(*order.keys).collect()]
        for skip, limit in ((0, 10), (95, 60), (290, 50), (300, 5), (0, 300)):
            page = cat.page_at(order, skip, limit)
            assert [r.id for r in page.collect()] == want[skip : skip + limit]
        assert "Offset" not in page._jdf.queryExecution().toString() and SHOWN[0] in page.columns
        seen, last = [], None
        while True:
            rows_ = cat.page_after(c, last, "confidence", descending, limit=40).collect()
            if not rows_:
                break
            seen += [r.id for r in rows_]
            last = (rows_[-1].confidence, rows_[-1].id)
        assert seen == want
    cat.write_order(shell, str(tmp_path / "none"), "id")
    assert cat.page_at(cat.read_order(spark, str(tmp_path / "none"), "id"), 0, 10).collect() == []


def test_search_filter_empty_is_true_and_paging_is_checked(spark, sf):
    from legajo.queries import catalog
    c = catalog(spark, sf)
    assert c.filter(cat.search_filter()).count() == c.count()
    assert c.filter(cat.export_filter({"min_confidence": 0, "document_type": ""})).count() == c.count()
    with pytest.raises(ValueError):
        cat.page(c, limit=1001)
    seen = [r.id for s in range(0, 200, 50) for r in cat.page(c, "tipo", skip=s).collect()]
    assert len(seen) == len(set(seen)) == 200


def test_filters_reach_the_files(spark, sf):
    from legajo.queries import catalog
    plan = catalog(spark, sf).filter(cat.search_filter(tipo="facturas", confidence_min=0.3)).select("id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tipo" in text and "GreaterThanOrEqual(confidence,0.3)" in text
    assert "texto_extraido" not in text


def test_classification_does_not_shuffle(spark, sf):
    from legajo.queries import decided
    text = decided(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in text and "Python" not in text


def test_create_append_and_read_catalog(spark, sf):
    from legajo.queries import catalog
    path = new_path(spark, "managed")
    cat.create_catalog(spark, "documentos", path)
    cat.create_catalog(spark, "documentos", path)
    rows = catalog(spark, sf)
    cat.append_catalog(rows, path)
    spark.sql("MSCK REPAIR TABLE documentos")
    assert spark.table("documentos").count() == rows.count()
    assert set(spark.table("documentos").columns) == set(rows.columns)
    spark.sql("DROP TABLE documentos")


def test_exports_and_empty_export(spark, sf):
    from legajo.queries import catalog
    c = catalog(spark, sf)
    done = exports.export_many(spark, c, new_path(spark, "many"), filters={"document_type": "cartas_porte"})
    assert {f: one(m).total_records for f, m in done.items()} == {f: c.filter("tipo = 'cartas_porte'").count() for f in exports.FORMATS}
    empty = one(exports.export(spark, c, new_path(spark, "none"), "csv", {"document_type": "x"}))
    assert empty.total_records == 0 and empty.warnings and empty.success
    with pytest.raises(ValueError):
        exports.export(spark, c, new_path(spark, "bad"), "pdf")


def test_xml_export_is_compressed_and_whole(spark, sf, tmp_path, monkeypatch):
    """Tags and indentation took eight times the room; files stay small enough to be read by many tasks."""
    from legajo.queries import catalog as stored
    monkeypatch.setattr(exports, "XML_ROWS_PER_FILE", 100)
    rows, path = stored(spark, sf).coalesce(2), str(tmp_path / "xml")
    exports.write_xml(rows, path)
    parts = [p for p in Path(path).glob("part-*")]
    wanted = {r.id: (r.tipo, r.monto) for r in rows.select("id", "tipo", "monto").collect()}
    assert all(p.suffix == ".gz" for p in parts) and len(parts) >= len(wanted) / 100
    assert sum(p.stat().st_size for p in parts) < 200 * len(wanted)
    back = spark.read.schema("id bigint, tipo string, monto string").format("xml").option("rowTag", "document").load(path).collect()
    assert len(back) == len(wanted) and {r.id: (r.tipo, r.monto) for r in back} == wanted


def test_several_exports_are_counted_without_a_search_for_their_schema(spark, sf, monkeypatch):
    """Without a schema each reader parses every record twice."""
    from pyspark.sql import DataFrameReader
    from legajo.queries import QUERIES
    given, schema, load = [], DataFrameReader.schema, DataFrameReader.load
    monkeypatch.setattr(DataFrameReader, "schema", lambda self, s: given.append(self) or schema(self, s))
    monkeypatch.setattr(DataFrameReader, "load", lambda self, *a, **b: load(self, *a, **b) if self in given else pytest.fail("no schema"))
    rows = QUERIES["export_several"](spark, sf).collect()
    assert sorted(r.format for r in rows) == ["csv", "json", "xml"] and all(r.total_records == r.read > 0 for r in rows)


def test_folder_scan_and_hashes(spark, tmp_path):
    import hashlib
    for name, size in (("a.pdf", 10), ("b.PDF", 20), ("c.txt", 5)):
        (tmp_path / name).write_bytes(b"x" * size)
    scan = files.scan_folder(spark, str(tmp_path))
    assert one(files.folder_status(files.supported(scan))).files == 2
    row = one(files.with_hashes(files.scan_folder(spark, str(tmp_path), "a.*")))
    assert row.sha256 == hashlib.sha256(b"x" * 10).hexdigest() and row.complete
    twice = files.merged_scans(files.scan_folder(spark, str(tmp_path), "*.pdf"), files.scan_folder(spark, str(tmp_path), "*.[pP]*"))
    assert twice.count() == 2


def test_stream_equals_batch(spark):
    source, target = new_path(spark, "in"), new_path(spark, "out")
    at = F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")
    rows = [(1, "a.pdf", dt.datetime(2024, 1, 1), "factura factura"), (2, "b.pdf", dt.datetime(2024, 1, 1), " "), (4, "d.pdf", dt.datetime(2024, 1, 1), "remito")]
    later = [(3, "c.pdf", dt.datetime(2024, 1, 2), "remito")]
    spark.createDataFrame(rows, ingest.DOCS_SCHEMA).write.parquet(source)
    files_ = [(i, f"/in/{i}.pdf", 5000, 2, i == 4, 0, 0, 500, 500, True) for i in (1, 2, 3, 4)]
    manifest = spark.createDataFrame(files_, (
        "doc_id bigint, path string, length bigint, page_count int, needs_pass boolean, permissions int, pages_with_images int, "
        "total_characters bigint, extractable_chars bigint, has_early_text boolean"))

    def run():
        ingest.ingest(spark, source, target, f"{target}/s", manifest, at).awaitTermination()

    run()
    run()
    spark.createDataFrame(later, ingest.DOCS_SCHEMA).write.mode("append").parquet(source)
    run()
    whole = spark.createDataFrame(rows + later, ingest.DOCS_SCHEMA)
    path = new_path(spark, "whole")

    def store(r):
        r.write.partitionBy("tipo").parquet(path)
        return spark.read.schema(r.schema).parquet(path)

    want = batch.process(whole, manifest, None, at, store)
    columns = ["doc_id", "success", "error", "classification", "confidence", "destination"]
    ordered = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=str)
    assert ordered(spark.read.parquet(f"{target}/results"), *columns) == ordered(want.results, *columns)
    assert ordered(spark.read.parquet(f"{target}/quarantine"), "path") == ordered(want.quarantine, "path") != []
    stored = spark.read.parquet(f"{target}/catalog")
    assert ordered(stored, "id", "tipo") == ordered(want.catalog, "id", "tipo") and len(ordered(stored, "id")) == 2


def test_user_scorer_joins_the_vote(spark):
    docs = spark.createDataFrame([(1, "texto")], "doc_id int, text string")
    mine = spark.createDataFrame([(1, "contratos", 0.9)], "doc_id int, type string, confidence double")
    from legajo.rules import ensemble
    weights = {**ensemble.WEIGHTS, "ml": 0.5}
    got = one(cat.classify(docs, extra_votes={"ml": mine}, weights=weights))
    assert got.tipo == "contratos" and got.confidence == pytest.approx(0.45)
    done = cat.classify(docs, None, ("keyword",), {"theirs": mine}, {"keyword": 0.1, "theirs": 0.5})
    got = one(cat.catalog_rows(done.withColumns({"filename": F.lit("f"), "processed_at": F.lit(None).cast("timestamp_ntz")})))
    assert got.metodos_usados == ["keyword", "theirs"] and set(got.detalles_clasificacion.method_results) == {"keyword", "theirs"}
    assert got.detalles_clasificacion.consensus.best_consensus == "contratos" and "theirs (0.90)" in got.detalles_clasificacion.decision.reasoning
    with pytest.raises(ValueError, match="theirs"):
        cat.classify(docs, None, ("keyword",), {"theirs": mine}, {"keyword": 0.1})


def test_shared_folder_setting(spark):
    assert shared_folder(spark)


def test_first_match(spark):
    rows = [(1, "a", dt.datetime(2024, 1, 1), "Nota de Credito y remito 20-12345678-1"), (2, "b", dt.datetime(2024, 1, 1), "carta de porte")]
    got = {r.id: r for r in batch.legacy_rows(spark.createDataFrame(rows, ingest.DOCS_SCHEMA)).collect()}
    assert (got[1].tipo, got[1].cuit, got[2].tipo) == ("remitos", "20-12345678-1", "cartas_porte")


def test_full_analysis_reads_the_layout_once(spark, tmp_path, monkeypatch):
    from legajo import queries

    sf = str(tmp_path)
    day = dt.date(1997, 5, 6)
    spark.createDataFrame([(k, 1, day, 10.0 * k) for k in (1, 2, 3)], "o_orderkey bigint, o_custkey bigint, o_orderdate date, o_totalprice double").write.parquet(f"{sf}/orders.parquet")
    spark.createDataFrame([(1, "BUILDING")], "c_custkey bigint, c_mktsegment string").write.parquet(f"{sf}/customer.parquet")
    spark.createDataFrame([(k, 4.0) for k in (1, 2, 3)], "l_orderkey bigint, l_quantity double").write.parquet(f"{sf}/lineitem.parquet")
    calls, scores = [], queries.layout.layout_scores
    monkeypatch.setattr(queries.layout, "layout_scores", lambda spans: calls.append(1) or scores(spans))
    rows = queries.QUERIES["full_analysis_details"](spark, sf).collect()
    assert len(calls) == 1
    assert sorted((r.doc_id, r.total_blocks) for r in rows) == [(1, 7), (2, 7), (3, 7)]
    assert all(r.layout_score >= r.layout_confidence for r in rows)


def test_files_of_a_written_table_hold_a_bounded_number_of_rows(spark, tmp_path):
    source = str(tmp_path / "few")
    rows = written_table(spark, "bounded", source, lambda: spark.range(0, 95, 1, 1), rows_per_file=10)
    per_file = rows.groupBy(F.input_file_name()).count().collect()
    assert sorted(r["count"] for r in per_file) == [5] + [10] * 9


def test_documents_are_written_in_files_that_spread_over_tasks(spark, sf, monkeypatch):
    from legajo import session
    from legajo.sources import tables
    monkeypatch.setattr(tables, "DOCS_PER_FILE", 100)
    monkeypatch.setattr(session, "_WRITTEN", {})
    docs = tables.business_docs(spark, sf)
    assert docs.count() > 100 and docs.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 100


def test_supplier_lines_are_not_searched_beyond_the_first_hit(spark):
    texts = [
        "nada\nRazón Social: ACME Rosario\nProveedor: Otra Firma", "Empresa: Uno Dos Tres\nRazón Social: Cuatro Cinco",
        "sin proveedor", "", None, "\n" * 9 + "Proveedor: Linea Diez", "\n" * 10 + "Proveedor: Linea Once",
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    found = docs.select("id", md.supplier_name(F.col("text")).alias("s"))
    assert [r.s for r in found.orderBy("id").collect()] == ["ACME Rosario", "Uno Dos Tres", None, None, None, "Linea Diez", None]
    assert "aggregate(" in found._jdf.queryExecution().optimizedPlan().toString()
