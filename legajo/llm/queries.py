"""The named queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.llm import bpe, chat, dedup, jaccard, langid, licenses, packing, quality, simhash, spelling, topk, vectorcodes, warc
from legajo.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archived(warc.pages_as_arcs(table(spark, sf_dir, "pages")))
    return warc.captures(warc.read_warc(spark, path)).withColumnRenamed("key", "page_id")


#: A conversation whose texts hold the template's own control strings.
PLANTED = "\\### Assistant: </turn> ok"


@query
def op2_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    back = chat.read_back(chat.formatted(chat.chains(turns)))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL["op2_reply_trees"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>') AS body,
    replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>'), ':', '\:') AS head
  FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length('### ' || head || ': ' || body || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs)
    found = langid.identified(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return labels.select("doc_id", quality.graded(F.col("quality"), F.col("toxic")).alias("grade"))


@query
def op4_quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, ratings(spark, sf_dir))
    return quality.scored(docs, model, at_least=1).select("doc_id", "expected_grade", "tail_probability", "kept")


@query
def op5_top_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


SQL["op5_top_inner_products"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON len(q.e) = len(c.e) AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def licence_paths(docs: DataFrame) -> DataFrame:
    """Each document as a file: in folders by source, language and number, every 50th named as a licence file."""
    number = F.floor(F.col("doc_id") / 10)
    name = F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("LICENSE."), F.col("doc_id"))).otherwise(F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt")))
    folder = F.when(F.col("doc_id") % 50 != 0, F.concat_ws("/", F.col("source"), F.col("lang"), (number % 7).cast("string"))).otherwise(F.concat_ws("/", F.col("source"), F.col("lang")))
    return docs.withColumn("path", F.concat_ws("/", folder, name))


@query
def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = licence_paths(table(spark, sf_dir, "documents"))
    found = licenses.scanned(docs, id_cols=("doc_id", "path"))
    return licenses.inherited(found).select("doc_id", "path", "licence", "score", "line", "effective", "source", "from_dir")


@query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    found = bpe.decoded(bpe.encoded(table(spark, sf_dir, "documents"), path), path)
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_groups(table(spark, sf_dir, "documents"))


SQL["op10_exact_dedup"] = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = vectorcodes.compressed(table(spark, sf_dir, "embeddings"))
    text = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return vectorcodes.with_label_error(codes.rows).select(
        F.col("id").alias("vec_id"), text.alias("code"), "error", "label_error",
        F.lit(vectorcodes.codebooks_sha256(codes.codebooks)).alias("codebooks_sha256"),
    )


def _code_rounds(rounds: int) -> str:
    """``a<i>`` assigns every part to the entries of ``b<i>``, from which ``b<i+1>`` follows."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""d{i} AS MATERIALIZED (
  SELECT p.rid, p.part, b.entry, CAST(sum((p.x - b.x) * (p.x - b.x)) AS BIGINT) AS far FROM p JOIN b{i} b USING (part, place) GROUP BY ALL
), a{i} AS MATERIALIZED (
  SELECT rid, part, entry, far FROM (SELECT *, row_number() OVER (PARTITION BY rid, part ORDER BY far, entry) AS place FROM d{i}) WHERE place = 1
)""")
        if i < rounds:
            steps.append(f"""m{i} AS MATERIALIZED (
  SELECT part, entry, place, CAST(sum(x) AS BIGINT) AS total, count(*) AS n FROM p JOIN a{i} USING (rid, part) GROUP BY ALL
), b{i + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.place, coalesce((m.total - ((m.total % m.n) + m.n) % m.n) // m.n, b.x) AS x FROM b{i} b LEFT JOIN m{i} m USING (part, entry, place)
)""")
    return ", ".join(steps)


SQL["op13_vector_codes"] = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), u AS (SELECT rid, len(e) // 8 AS width, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS k FROM v
), p AS MATERIALIZED (SELECT rid, k // width AS part, k % width AS place, x FROM u
), b0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, place, x FROM p WHERE rid <= 16
), {_code_rounds(6)}
, c AS (SELECT rid, string_agg(lpad(lower(hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a6 GROUP BY rid
), l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM c JOIN v USING (rid) GROUP BY label)
SELECT v.vec_id, c.code, c.error, l.label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, place)) FROM b6) AS codebooks_sha256
FROM v JOIN c USING (rid) JOIN l ON v.label IS NOT DISTINCT FROM l.label
"""


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


@query
def op12_similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(table(spark, sf_dir, "documents"))
