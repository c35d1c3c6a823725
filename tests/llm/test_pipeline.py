"""Queries against SQL and brute force, and the pipeline stage by stage."""

import hashlib
from collections import defaultdict

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as spark_entry
import corpus_pipeline
from legajo.llm import simhash
from legajo.llm.queries import QUERIES, SQL

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, db, sf, name):
    got = QUERIES[name](spark, sf)
    want = db.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(spark_entry.queries()) and set(SQL) <= set(spark_entry.oracle_sql())


def test_bpe_query(spark, db, sf):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for i, t in db.execute("SELECT doc_id, text FROM documents").fetchall():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op9_bpe_round_trip"](spark, sf).collect()}
    assert got == want


def test_archive_query(spark, db, sf):
    pages = db.execute("SELECT page_id, html FROM pages").fetchall()
    best = defaultdict(int)
    for i, h in pages:
        best[h or ""] = max(best[h or ""], i)
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in QUERIES["op1_arc_to_warc"](spark, sf).collect()}
    assert got == {i: (len((h or "").encode()), *(("response", None) if best[h or ""] == i else ("revisit", best[h or ""]))) for i, h in pages}


def near_labels(texts):
    fps = [simhash.fingerprint(t) for t in texts]
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def test_stages(spark, db, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf), name)
        kept[name] = docs
        if name != "best_fit_packing":
            assert docs.columns == columns

    rows = {name: {r.doc_id: r.text for r in d.collect()} for name, d in kept.items() if name != "best_fit_packing"}
    quality = dict(db.execute("SELECT doc_id, quality FROM labels").fetchall())
    first = rows["quality_classifier"]
    good, poor = [i for i, q in quality.items() if q], [i for i, q in quality.items() if not q]
    assert sum(i in first for i in good) >= 0.97 * len(good) and sum(i in first for i in poor) <= 0.2 * len(poor)
    assert len(rows["language_id"]) >= 0.99 * len(first)

    best = defaultdict(int)
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    for i, t in rows["language_id"].items():
        best[lower(t)] = max(best[lower(t)], i)
    assert set(rows["exact_dedup"]) == set(best.values())

    ids = sorted(rows["exact_dedup"])
    label = near_labels([rows["exact_dedup"][i] for i in ids])
    assert set(rows["simhash_near_dedup"]) == {ids[k] for k in {lb: label.index(lb) for lb in label}.values()}

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens, fill = defaultdict(int), defaultdict(int)
    for r in kept["best_fit_packing"].collect():
        tokens[r.doc_id] += r.length
        fill[r.sequence_id] += r.length
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows["simhash_near_dedup"].items()}
    assert tokens == want and max(fill.values()) <= 2048
    assert len(fill) <= 1.05 * sum(want.values()) / 2048 + 1
