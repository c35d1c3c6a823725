import re

import pytest
import reference_rules as brute
import texts
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from legajo.functions import text as tx
from legajo.operators import catalog as cat
from legajo.operators import classify
from legajo.operators.suppliers import detect_supplier
from legajo.rules import agro, commercial, edit, patterns, types
from legajo.sources.registry import built_in_rows


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.createDataFrame(list(enumerate(texts.ALL)), "doc_id int, text string")
    voted = detect_supplier(classify.rule_votes(docs), built_in_rows())
    return {r.doc_id: r for r in voted.collect()}


@pytest.mark.parametrize("i", range(len(texts.ALL)))
def test_votes_match_brute_force(scored, i):
    text, row = texts.ALL[i], scored[i]
    for vote, (kind, score) in [
        (row.keyword, brute.keyword(text)), (row.regex, brute.regex(text)),
        (row.agro, brute.domain(text, agro)), (row.commercial, brute.domain(text, commercial)),
    ]:
        assert vote.type == kind
        assert vote.confidence == pytest.approx(score, abs=1e-9)
    kind, score = brute.supplier(text)
    assert row.supplier_id == kind and row.supplier_confidence == pytest.approx(score)


def test_whole_documents_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for r in classify.rule_votes(docs).collect():
        assert (r.keyword.type, round(r.keyword.confidence, 9)) == (lambda k: (k[0], round(k[1], 9)))(brute.keyword(r.text))
        assert r.regex.type == brute.regex(r.text)[0]
        assert r.agro.confidence == pytest.approx(brute.domain(r.text, agro)[1])
        assert r.commercial.confidence == pytest.approx(brute.domain(r.text, commercial)[1])


def _patterns():
    found = [p for e in patterns.TYPE_PATTERNS.values() for p in e] + list(patterns.TABLE_PATTERNS) + list(patterns.TAX_PATTERNS)
    for rules in (agro, commercial):
        found += [p for s in rules.TYPES.values() for p in s["patterns"]] + [p for e in rules.ELEMENTS.values() for p in e]
    return sorted({tx.lowered(p) for p in found})


@pytest.mark.parametrize("pattern", _patterns())
def test_guard_literals_are_in_every_match(pattern):
    literals = tx.guard_literals(pattern)
    if not literals:
        return

    @settings(max_examples=25, deadline=None, database=None)
    @given(st.from_regex(re.compile(pattern), fullmatch=True))
    def check(match):
        assert any(x in match for x in literals)

    check()


@pytest.mark.parametrize("literals", [
    {"fac", "fact", "factura", "actu"}, {"op", "orden", "orden de pago", "de"}, {"a.b", "a|b", "(x", "ña"},
])
def test_trie_finds_every_literal(literals):
    trie = re.compile(f"(?=({tx._trie_pattern(sorted(literals))}))")
    text = "la factura a.b de orden de pago a|b (x ñandú ña op fac"
    found = trie.findall(text)
    for x in literals:
        assert (x in text) == any(f.startswith(x) for f in found)


def test_golden_decision(spark):
    docs = spark.createDataFrame([(1, texts.GOLDEN), (2, ""), (3, None)], "doc_id int, text string")
    rows = {r.doc_id: r for r in cat.classify(docs).collect()}
    golden = rows[1]
    assert golden.tipo == "ordenes_pago"
    assert golden.confidence == pytest.approx(0.185167, abs=1e-6)
    assert golden.decision.reasoning == "Métodos coincidentes: commercial (0.84) | Confianza media (0.185)"
    assert not golden.consensus.has_strong_consensus and golden.consensus.total_methods == 3
    for empty in (rows[2], rows[3]):
        assert (empty.tipo, empty.confidence, empty.decision.reasoning) == ("desconocido", 0.0, "")


def test_expected_categories(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts.EXPECTED)], "doc_id int, text string")
    rows = {r.doc_id: r.tipo for r in cat.classify(docs).select("doc_id", "tipo").collect()}
    wrong = [(texts.EXPECTED[i][0], rows[i]) for i in rows if rows[i] not in texts.EXPECTED[i][1]]
    assert not wrong


def test_ties_follow_declared_order(spark):
    text = "contrato contract convenio acuerdo"
    assert brute.keyword(text)[0] == "contratos_granos"
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert classify.rule_votes(docs, ["keyword"]).first().keyword.type == "contratos_granos"


def test_declared_types_and_scores(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    known = [*types.TYPE_KEYWORDS, types.UNKNOWN]
    bad = classify.rule_votes(docs, ["keyword"]).filter(
        ~F.col("keyword.confidence").between(0, 1) | ~F.col("keyword.type").isin(*known))
    assert bad.count() == 0


def test_fixed_rounds_like_the_exact_value(spark):
    values = [k / 64 for k in range(65)] + [k / 1000 for k in range(1001)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", tx.fixed(F.col("x"), 2).alias("s"))
    assert all(r.s == f"{r.x:.2f}" for r in rows.collect())


def test_edited_rules(spark):
    keywords = edit.with_type(types.TYPE_KEYWORDS, "polizas", ["póliza", "aseguradora"])
    assert edit.with_updated_type(keywords, "nada", ["x"]) == keywords
    keywords = edit.with_updated_type(keywords, "remitos", ["bulto"])
    exprs = edit.with_pattern(patterns.TYPE_PATTERNS, "polizas", r"P[ÓO]LIZA\s+\d+")
    with pytest.raises(ValueError):
        edit.with_pattern(exprs, "polizas", "(")
    docs = spark.createDataFrame([(1, "Póliza 77 de la ASEGURADORA"), (2, "remito remito")], "doc_id int, text string")
    rows = {r.doc_id: r for r in classify.rule_votes(docs, ["keyword", "regex"], keywords, exprs).collect()}
    assert rows[1].keyword.type == "polizas" and rows[1].regex.type == "polizas"
    assert rows[1].regex.confidence == pytest.approx(1 / 3)
    assert rows[2].keyword.confidence == 0
    digits = edit.with_pattern({}, "numeros", r"\d\d")
    only = classify.rule_votes(spark.createDataFrame([(1, "12 34"), (2, "x")], "doc_id int, text string"), ["regex"], exprs=digits)
    assert {r.doc_id: (r.regex.type, r.regex.confidence) for r in only.collect()} == {
        1: ("numeros", pytest.approx(2 / 3)), 2: ("desconocido", 0.0)}


FORMS = [
    (r"\AFACTURA", "FACTURA N 1"), (r"TOTAL\Z", "el TOTAL"), (r"\xC9POCA", "la ÉPOCA"), (r"(?P<Num>\d+)-(?P=Num)", "12-12"), (r"[^A-Z\s]+\S\D\W", "..aB, "),
    (r"[A-F]{3}\B", "xABCx"), (r"\u00D1u", "ÑU"), (r"(?i:Total)\b", "TOTAL 1"), (r"FACTURA", "factura"),
]


@pytest.mark.parametrize(("pattern", "text"), FORMS)
def test_edited_patterns_keep_their_meaning(spark, pattern, text):
    rules = edit.with_pattern({}, "t", pattern)
    rows = [(0, text), (1, text.lower()), (2, text.upper()), (3, "zz"), (4, f"a\n{text}\nb"), (5, f"{text}!")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r.doc_id: r.regex.confidence > 0 for r in classify.rule_votes(docs, ["regex"], exprs=rules).collect()}
    assert got == {i: re.search(pattern, t, re.I | re.M) is not None for i, t in rows}


@pytest.mark.parametrize("pattern", [r"[A-z]", r"\101", r"\N{BULLET}", r"(?a)x", "(", "İ"])
def test_patterns_without_a_lower_form_are_refused(pattern):
    with pytest.raises(ValueError):
        edit.with_pattern({}, "t", pattern)
