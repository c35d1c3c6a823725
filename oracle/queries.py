"""Expected result of each named query as one SQL statement."""

from __future__ import annotations

from legajo.rules import agro, commercial, layout, metadata, patterns, training, types
from legajo.rules import catalog as cat
from legajo.sources.derived import MANIFEST_SQL, OPERATION_LOG_SQL
from oracle.sql import (
    CTES, _coalesce_extract, _fix_final, count_of, keyword_ctes, lit, num, regex_ctes, rx, statement, vote_ctes,
)

METHODS = ["keyword", "regex", "agro", "commercial"]
SQL: dict[str, str] = {}
EXTRA: dict[str, tuple[str, list[str]]] = {
    "manifest": (MANIFEST_SQL.format(orders="orders"), []),
    "oplog": (OPERATION_LOG_SQL.format(events="events"), []),
    "pages_": ("SELECT conv_id AS doc_id, turn + 1 AS page_num, role, text FROM conversations", []),
    "reg": (
        "SELECT s_suppkey AS ord, concat('sup_', s_suppkey) AS supplier_id, s_name AS name, "
        "concat('30-', lpad(cast(s_suppkey AS string), 8, '0'), '-', s_suppkey % 10) AS cuit, "
        "s_acctbal < 0 AS in_debt, s_nationkey AS nation FROM supplier", []),
    "corr": (
        "SELECT id AS doc_id, 'facturas' AS tipo, fecha_procesado AS ts FROM catalog WHERE tipo = 'desconocido' UNION ALL "
        "SELECT id, CASE WHEN id % 5 = 0 THEN 'sin_categoria' WHEN id % 2 = 0 THEN 'otros' ELSE 'remitos' END, "
        "fecha_procesado + INTERVAL 1 DAY FROM catalog WHERE tipo = 'desconocido'", ["catalog"]),
    "last_corr": (
        f"SELECT doc_id, tipo FROM corr WHERE tipo IN ({', '.join(lit(c) for c in cat.REVIEW_CATEGORIES)}) "
        "QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ts DESC, tipo DESC) = 1", ["corr"]),
    "reviewed": (
        "SELECT c.* EXCLUDE (tipo), coalesce(l.tipo, c.tipo) AS tipo FROM catalog c LEFT JOIN last_corr l ON l.doc_id = c.id",
        ["catalog", "last_corr"]),
}


def _r(column: str, name: str | None = None) -> str:
    return f"round({column}, 6) AS {name or column.split('.')[-1]}"


# ---------------------------------------------------------------- Naive Bayes


def nb_ctes(p: str, samples: str, docs: str, deps: list[str] | None = None) -> dict[str, tuple[str, list[str]]]:
    """Fitted on the training part: all samples but, from 20 on, the first fifth of each label by a hash of the id."""
    stop = ", ".join(lit(w) for w in dict.fromkeys(training.STOP_WORDS))
    words = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'), lambda x: NOT list_contains([" + stop + "], x))"
    grams = "w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    return {
        f"{p}all": (samples, deps or []),
        f"{p}flags": (
            f"SELECT *, (SELECT count(*) FROM {p}all) < 20 AS few, row_number() OVER (PARTITION BY label ORDER BY "
            f"md5(doc_id || '-42'), doc_id) <= round(count(*) OVER (PARTITION BY label) * 0.2e0) AS is_test FROM {p}all", [f"{p}all"]),
        f"{p}samples": (f"SELECT doc_id, label, text FROM {p}flags WHERE few OR NOT is_test", [f"{p}flags"]),
        f"{p}test": (f"SELECT doc_id, label, text FROM {p}flags WHERE few OR is_test", [f"{p}flags"]),
        f"{p}counts": (
            f"SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({grams}) AS term FROM "
            f"(SELECT doc_id, {words} AS w FROM {p}samples)) GROUP BY 1, 2", [f"{p}samples"]),
        f"{p}vocab": (
            f"SELECT term, ln((1.0e0 + (SELECT count(*) FROM {p}samples)) / (1.0e0 + count(*))) + 1 AS idf FROM {p}counts "
            f"GROUP BY term HAVING count(*) >= 2 AND count(*) <= {num(0.8)} * (SELECT count(*) FROM {p}samples) "
            f"ORDER BY sum(n) DESC, term LIMIT 5000", [f"{p}counts"]),
        f"{p}w": (
            f"SELECT doc_id, term, n * idf / sqrt(sum(n * idf * n * idf) OVER (PARTITION BY doc_id)) AS weight "
            f"FROM {p}counts JOIN {p}vocab USING (term)", [f"{p}counts", f"{p}vocab"]),
        f"{p}grid": (
            f"SELECT l.label, v.term, v.idf, 1.0e0 + coalesce(s.s, 0) AS s FROM {p}vocab v, (SELECT DISTINCT label FROM {p}samples) l "
            f"LEFT JOIN (SELECT label, term, sum(weight) AS s FROM {p}w JOIN {p}samples USING (doc_id) GROUP BY 1, 2) s "
            "ON s.label = l.label AND s.term = v.term", [f"{p}w", f"{p}samples", f"{p}vocab"]),
        f"{p}model": (
            f"SELECT label, term, idf, ln(s) - ln(sum(s) OVER (PARTITION BY label)) AS log_prob FROM {p}grid", [f"{p}grid"]),
        f"{p}priors": (
            f"SELECT label, ln(count(*)) - ln((SELECT count(*) FROM {p}samples)) AS log_prior FROM {p}samples GROUP BY label",
            [f"{p}samples"]),
        f"{p}docs": (docs, ["docs"] if "FROM docs" in docs else []),
        f"{p}dcounts": (
            f"SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({grams}) AS term FROM "
            f"(SELECT doc_id, {words} AS w FROM {p}docs)) JOIN {p}vocab USING (term) GROUP BY 1, 2", [f"{p}docs", f"{p}vocab"]),
        f"{p}like": (
            f"SELECT doc_id, label, sum(n * idf * log_prob) / sqrt(sum(n * idf * n * idf)) AS likelihood "
            f"FROM {p}dcounts JOIN {p}model USING (term) GROUP BY 1, 2", [f"{p}dcounts", f"{p}model"]),
        f"{p}joint": (
            f"SELECT d.doc_id, p.label, p.log_prior + coalesce(l.likelihood, 0) AS score FROM {p}docs d CROSS JOIN {p}priors p "
            f"LEFT JOIN {p}like l ON l.doc_id = d.doc_id AND l.label = p.label", [f"{p}docs", f"{p}priors", f"{p}like"]),
        f"{p}probs": (
            f"SELECT doc_id, label, e / sum(e) OVER (PARTITION BY doc_id) AS probability FROM (SELECT *, "
            f"exp(score - max(score) OVER (PARTITION BY doc_id)) AS e FROM {p}joint)", [f"{p}joint"]),
        f"{p}pred": (
            f"SELECT doc_id, label AS type, probability AS confidence FROM {p}probs QUALIFY row_number() OVER "
            "(PARTITION BY doc_id ORDER BY probability DESC, label) = 1", [f"{p}probs"]),
    }


SAMPLE_VALUES = ", ".join(f"({i}, {lit(l)}, {lit(t)})" for i, (l, t) in enumerate(training.SAMPLES))
LABELLED = "SELECT d.doc_id, d.text, cast(l.quality AS string) AS label FROM documents d JOIN labels l USING (doc_id)"
EXTRA |= nb_ctes("q_", LABELLED, "SELECT doc_id, text FROM documents")
EXTRA |= nb_ctes("b_", f"SELECT * FROM (VALUES {SAMPLE_VALUES}) v(doc_id, label, text)", "SELECT doc_id, text FROM docs")
EXTRA |= nb_ctes(
    "f_", f"SELECT -1 - doc_id AS doc_id, label, text FROM (VALUES {SAMPLE_VALUES}) v(doc_id, label, text) UNION ALL "
    "SELECT l.doc_id, l.tipo, c.texto_extraido FROM last_corr l JOIN catalog c ON c.id = l.doc_id", "SELECT 0 AS doc_id, '' AS text",
    ["last_corr", "catalog"])
EXTRA["v_ml"] = ("SELECT doc_id, type, confidence FROM b_pred", ["b_pred"])

# ---------------------------------------------------------------- layout


def _layout_ctes() -> dict[str, tuple[str, list[str]]]:
    words = " + ".join(f"CAST(contains(lower(text), {lit(w)}) AS INT)" for w in layout.TABLE_WORDS)
    title_word = " OR ".join(f"contains(lower(trim(text)), {lit(w)})" for w in layout.TITLE_WORDS)
    scores = []
    for name, spec in layout.TYPES.items():
        title = " OR ".join(f"contains(coalesce(t.titles, ''), {lit(k)})" for k in spec["titles"])
        parts = [f"CASE WHEN {title} THEN 1e0 ELSE 0 END"]
        parts.append("CASE WHEN has_table THEN 1e0 ELSE 0 END" if spec["table_terms"] else "CASE WHEN NOT has_table THEN 0.5e0 ELSE 0 END")
        near = " OR ".join(f"abs(common_size - {s}) <= 2" for s in spec["sizes"])
        parts.append(f"CASE WHEN common_size IN ({', '.join(map(str, spec['sizes']))}) THEN 1e0 WHEN {near} THEN 0.5e0 ELSE 0 END")
        parts.append(f"CASE WHEN left_margin > {num(0.05)} AND right_margin > {num(0.05)} THEN 0.5e0 ELSE 0 END")
        parts.append(f"CASE WHEN top_margin > {num(0.05)} AND bottom_margin > {num(0.05)} THEN 0.5e0 ELSE 0 END")
        if spec["taxed"]:
            tax = " OR ".join(f"contains(full_text, {lit(w)})" for w in layout.TAX_WORDS)
            parts.append(f"CASE WHEN {tax} THEN 0.5e0 ELSE 0 END")
        if spec["table_terms"]:
            hits = " + ".join(f"CAST(contains(full_text, {lit(w)}) AS INT)" for w in spec["table_terms"])
            parts.append(f"least(({hits}) / {num(float(len(spec['table_terms'])))}, 0.5e0)")
        scores.append(f"least(({' + '.join(parts)}) / 5e0, 1e0) AS score_{name}")
    columns = [f"score_{t}" for t in layout.TYPES]
    top = f"greatest({', '.join(columns)})"
    whens = " ".join(f"WHEN score_{t} = {top} THEN {lit(t)}" for t in layout.TYPES)
    return {
        "spans": (
            "SELECT doc_id, line, text, CASE WHEN line = 0 THEN 16e0 ELSE 10e0 END AS size, "
            "(CASE WHEN line % 2 = 1 THEN 60e0 ELSE 40e0 END) / 595 AS x_min, "
            "((CASE WHEN line % 2 = 1 THEN 60e0 ELSE 40e0 END) + length(text) * 6) / 595 AS x_max, "
            "(40 + 90 * line) / 842e0 AS y_min, (40 + 90 * line + 14) / 842e0 AS y_max FROM ("
            "SELECT doc_id, unnest(string_split(text, chr(10))) AS text, "
            "generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM docs)", ["docs"]),
        "zoned": (
            "SELECT *, CASE WHEN (y_min + y_max) / 2 <= 0.15 THEN 'header' WHEN (y_min + y_max) / 2 >= 0.85 THEN 'footer' "
            "WHEN (y_min + y_max) / 2 <= 0.25 THEN 'title' ELSE 'content' END AS zone FROM spans", ["spans"]),
        "bounds": (
            "SELECT doc_id, min(x_min) AS x_min, max(x_max) AS x_max, min(y_min) AS y_min, max(y_max) AS y_max, "
            "min(x_min) AS left_margin, 1 - max(x_max) AS right_margin, min(y_min) AS top_margin, 1 - max(y_max) AS bottom_margin "
            "FROM spans GROUP BY doc_id", ["spans"]),
        "fontstats": (
            "SELECT f.doc_id, common_size, n_sizes, mean_size FROM (SELECT doc_id, count(DISTINCT size) AS n_sizes, avg(size) AS mean_size "
            "FROM spans GROUP BY doc_id) f JOIN (SELECT doc_id, size AS common_size FROM spans GROUP BY doc_id, size "
            "QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(line)) = 1) c USING (doc_id)", ["spans"]),
        "tabled": (
            f"SELECT doc_id, CAST(sum({words}) AS BIGINT) AS table_words, CAST(0 AS BIGINT) AS aligned_blocks, sum({words}) >= 3 AS has_table "
            "FROM spans GROUP BY doc_id", ["spans"]),
        "titled": (
            "SELECT doc_id, trim(text) AS title, size, y_min AS position FROM spans WHERE y_min <= 0.25 AND length(trim(text)) > 5 "
            f"AND (size > 12 OR (text = upper(text) AND text <> lower(text))) AND ({title_word})", ["spans"]),
        "lay": (
            f"SELECT *, {top} AS confidence0, CASE {whens} END AS best FROM (SELECT x.doc_id, {', '.join(scores)} FROM ("
            "SELECT doc_id, string_agg(lower(text), ' ' ORDER BY line) AS full_text FROM spans GROUP BY doc_id) x "
            "JOIN bounds USING (doc_id) JOIN fontstats USING (doc_id) JOIN tabled USING (doc_id) LEFT JOIN ("
            "SELECT doc_id, string_agg(lower(title), chr(1)) AS titles FROM titled GROUP BY doc_id) t USING (doc_id))",
            ["spans", "bounds", "fontstats", "tabled", "titled"]),
        "v_layout": ("SELECT doc_id, CASE WHEN confidence0 > 0 THEN best ELSE 'desconocido' END AS type, confidence0 AS confidence FROM lay", ["lay"]),
    }


EXTRA |= _layout_ctes()
EXTRA |= _fix_final(vote_ctes(["keyword", "regex", "agro", "commercial", "ml", "layout"], "_six"))


def add(name: str, body: str) -> None:
    SQL[name] = statement(body, EXTRA)


# ---------------------------------------------------------------- scoring

add("flagship_types_confidence", "SELECT tipo, count(*) AS n, round(avg(confidence), 6) AS avg_confidence FROM decided_two GROUP BY tipo")
for m in METHODS:
    add(f"{m}_scores", f"SELECT doc_id, type, {_r('confidence')} FROM v_{m}")
SQL["keyword_scores_documents"] = statement(f"SELECT doc_id, type, {_r('confidence')} FROM v_keyword").replace(
    CTES["docs"][0], "SELECT doc_id, text FROM documents")
add("keyword_details", " UNION ALL ".join(
    f"SELECT doc_id, {lit(t)} AS doc_type, {_r(f'k{i}', 'score')}, array_to_string(list_filter(["
    + ", ".join(lit(k) for k in words) + f"], lambda x: contains(t, x)), '|') AS keywords FROM kw_scores WHERE k{i} > 0"
    for i, (t, words) in enumerate(types.TYPE_KEYWORDS.items())))
add("term_profile", " UNION ALL ".join(
    f"SELECT doc_id, {lit(t)} AS term, CAST({count_of('lower(text)', t)} AS BIGINT) AS n FROM docs WHERE contains(lower(text), {lit(t)})"
    for t in types.PROFILE_TERMS))
_first = " ".join(
    f"WHEN {' OR '.join(f'contains(lower(text), {lit(x)})' for x in terms)} THEN {lit(t)}" for t, terms in types.FIRST_MATCH_TERMS)
EXTRA["legacy"] = (
    f"SELECT doc_id AS id, filename, CASE {_first} ELSE 'desconocido' END AS tipo, "
    f"nullif(regexp_extract(text, {rx(metadata.TAX_ID)}), '') AS cuit FROM docs", ["docs"])
add("legacy_first_match", "SELECT id, filename, tipo, cuit FROM legacy")


def _found(pattern: str) -> str:
    import re
    n = re.compile(pattern).groups
    if n <= 1:
        return f"regexp_extract_all(text, {rx(pattern, 'im')}, {n})"
    return (f"list_transform(list_zip(regexp_extract_all(text, {rx(pattern, 'im')}, 1), regexp_extract_all(text, {rx(pattern, 'im')}, 2)), "
            "lambda z: concat_ws(' ', z[1], z[2]))")


add("regex_match_details", "SELECT doc_id, type, pattern_no, CAST(len(f) AS BIGINT) AS n_matches, array_to_string(f, '|') AS matches FROM (" + " UNION ALL ".join(
    f"SELECT doc_id, {lit(t)} AS type, CAST({i + 1} AS BIGINT) AS pattern_no, {_found(p)} AS f FROM docs"
    for t, exprs in patterns.TYPE_PATTERNS.items() for i, p in enumerate(exprs)) + ") WHERE len(f) > 0")


def _any(exprs: list[str], flags: str) -> str:
    return "(" + " OR ".join(f"regexp_matches(text, {rx(p, flags)})" for p in exprs) + ")"


_tax = " + ".join(f"CAST(regexp_matches(text, {rx(p)}) AS INT)" for p in patterns.TAX_PATTERNS)
add("doc_structure", (
    "SELECT *, (CAST(has_header AS INT) + CAST(has_table AS INT) + CAST(has_totals AS INT) + CAST(tax_compliant AS INT)) / 4e0 AS structure_score "
    f"FROM (SELECT doc_id, {_any(patterns.HEADER_PATTERNS, 'm')} AS has_header, {_any(patterns.TABLE_PATTERNS, 'i')} AS has_table, "
    f"{_any(patterns.TOTAL_PATTERNS, 'i')} AS has_totals, ({_tax}) >= 2 AS tax_compliant FROM docs)"))
add("domain_flags", (
    f"SELECT doc_id, a.confidence > {num(0.3)} AS is_agro, c.confidence > {num(0.3)} AS is_commercial "
    "FROM v_agro a JOIN v_commercial c USING (doc_id)"))
_grains = "[" + ", ".join(lit(g) for g in agro.GRAINS) + "]"
add("agro_indicators", (
    f"SELECT doc_id, array_to_string(list_filter({_grains}, lambda g: contains(lower(text), g)), '|') AS grains_mentioned, "
    f"array_to_string(list_transform(list_zip(regexp_extract_all(text, {rx(agro.WEIGHT)}, 1), regexp_extract_all(text, {rx(agro.WEIGHT)}, 2)), "
    "lambda z: z[1] || ' ' || z[2]), '|') AS weights_found, "
    f"array_to_string({' || '.join(f'regexp_extract_all(text, {rx(p)}, 1)' for p in agro.PRICES)}, '|') AS prices_found, "
    f"array_to_string(list_transform(list_zip(regexp_extract_all(text, {rx(agro.QUALITY)}, 1), regexp_extract_all(text, {rx(agro.QUALITY)}, 2)), "
    "lambda z: z[1] || ': ' || z[2] || '%'), '|') AS quality_params, "
    f"array_to_string(regexp_extract_all(text, {rx(agro.DATE)}, 1), '|') AS dates_found FROM docs"))


def _all_of(exprs: list[str]) -> str:
    return " || ".join(f"regexp_extract_all(text, {rx(p)}, 1)" for p in exprs)


add("commercial_indicators", (
    f"SELECT doc_id, array_to_string(list_transform({_all_of(commercial.AMOUNTS)}, lambda a: '$' || a), '|') AS amounts_found, "
    f"array_to_string({_all_of(commercial.ACCOUNTS)}, '|') AS account_numbers, array_to_string({_all_of(commercial.BANKS)}, '|') AS banks_mentioned, "
    f"array_to_string({_all_of([commercial.PAYMENT])}, '|') AS payment_methods, array_to_string({_all_of([commercial.DATE])}, '|') AS dates_found FROM docs"))

# ---------------------------------------------------------------- metadata and suppliers

add("meta_cuit", "SELECT doc_id, cuit FROM meta")
add("meta_dates", "SELECT doc_id, array_to_string(dates, '|') AS dates FROM meta")
add("meta_amounts", "SELECT doc_id, array_to_string(amounts, '|') AS amounts FROM meta")
add("meta_supplier", "SELECT doc_id, supplier FROM meta")
add("meta_document_number", "SELECT doc_id, document_number FROM meta")
add("meta_all", (
    "SELECT doc_id, cuit, array_to_string(dates, '|') AS dates, array_to_string(amounts, '|') AS amounts, supplier, document_number, "
    "'2001-08-01 12:00:00' AS extracted_at FROM meta"))
add("supplier_detect", f"SELECT doc_id, supplier_id, {_r('supplier_confidence')} FROM sup")
add("supplier_fields", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT doc_id, {lit(f)} AS field, {_coalesce_extract('text', exprs)} AS value FROM docs"
    for f, exprs in metadata.SUPPLIER_FIELDS.items()) + ") WHERE value IS NOT NULL")
_known = ", ".join(
    f"({lit(s['supplier_id'])}, {lit('|'.join(s['names']))}, {lit(s['cuit'])})" for s in __import__(
        "legajo.rules.suppliers", fromlist=["SUPPLIERS"]).SUPPLIERS)
add("supplier_lookup", (
    f"SELECT doc_id, sup.supplier_id, k.names, k.cuit FROM sup LEFT JOIN (VALUES {_known}) k(supplier_id, names, cuit) ON k.supplier_id = sup.supplier_id"))
add("supplier_boost", (
    "SELECT c.id, c.proveedor_id AS supplier_id, c.tipo AS doc_type, round(coalesce(b.boost, 0), 6) AS supplier_boost FROM catalog c "
    "LEFT JOIN boosts b ON b.supplier_id = c.proveedor_id AND b.type = c.tipo"))
add("supplier_search", (
    "SELECT supplier_id, name, cuit, CASE WHEN contains(cuit, '7') THEN 1e0 ELSE 0.8e0 END AS match_score FROM reg "
    "WHERE contains(upper(name), '7') OR contains(cuit, '7')"))
add("registry_upsert", (
    "SELECT supplier_id, CASE WHEN in_debt THEN name || ' (deudor)' ELSE name END AS name FROM reg "
    "UNION ALL SELECT 'new_' || supplier_id, name FROM reg WHERE nation = 1"))
add("registry_update_existing", "SELECT supplier_id, CASE WHEN in_debt THEN upper(name) ELSE name END AS name FROM reg")
add("registry_merge_terms", (
    "SELECT supplier_id, 'facturas' AS doc_type, CASE WHEN in_debt THEN upper(name) ELSE upper(name) || '|' || cuit END AS specific_terms, "
    "CASE WHEN in_debt THEN 'PRÓXIMO VENCIMIENTO' ELSE 'PRÓXIMO VENCIMIENTO|TRACKING' END AS layout_indicators, 0.3e0 AS confidence_boost FROM reg "
    "UNION ALL SELECT supplier_id, 'recibos', lower(name) || '|' || cuit, 'próximo vencimiento|TRACKING', 0.1e0 FROM reg WHERE in_debt"))

# ---------------------------------------------------------------- votes and decision

add("votes_long", f"SELECT doc_id, method, type, {_r('confidence')} FROM votes")
add("consensus_stats", (
    f"SELECT doc_id, type, vote_count, {_r('share', 'vote_percentage')}, {_r('avg_confidence')}, {_r('max_confidence')}, methods FROM stats"))
add("consensus_best", (
    "SELECT doc_id, type AS best_consensus, vote_count, CAST(total AS BIGINT) AS total_methods, strong AS has_strong_consensus FROM best"))
add("weighted_scores", f"SELECT doc_id, type, {_r('score')} FROM scores")
add("ensemble", (
    f"SELECT d.doc_id, tipo, {_r('confidence')}, supplier_id, {_r('supplier_boost')}, {_r('consensus_factor')}, best_consensus, "
    "strong AS has_strong_consensus, CAST(total_methods AS BIGINT) AS total_methods FROM decided d JOIN sup USING (doc_id)"))
add("ensemble_reason", "SELECT doc_id, reasoning FROM reasons")
add("ensemble_reason_two_methods", "SELECT doc_id, tipo, reasoning FROM reasons_two JOIN decided_two USING (doc_id)")
_half = statement(f"SELECT doc_id, tipo, {_r('confidence')} FROM decided_two", EXTRA)
SQL["ensemble_user_weights"] = _half.replace(
    f"{num(0.15)} AS weight, type, confidence FROM v_keyword", f"{num(0.5)} AS weight, type, confidence FROM v_keyword").replace(
    f"{num(0.15)} AS weight, type, confidence FROM v_regex", f"{num(0.5)} AS weight, type, confidence FROM v_regex")
add("ensemble_all_methods", (
    f"SELECT d.doc_id, tipo, {_r('d.confidence')}, m.type AS ml_type, l.type AS layout_type, best_consensus "
    "FROM decided_six d JOIN v_ml m ON m.doc_id = d.doc_id JOIN v_layout l ON l.doc_id = d.doc_id"))
_kinds = " + ".join(
    "CAST(" + " OR ".join(f"contains(t, {lit(k)})" for k in words) + " AS BIGINT)" for words in types.TYPE_KEYWORDS.values())
_hits = " + ".join(f"CAST(regexp_matches(text, {rx(p, 'im')}) AS BIGINT)" for e in patterns.TYPE_PATTERNS.values() for p in e)
add("full_analysis", (
    f"SELECT d.doc_id, tipo, {_r('d.confidence')}, {_kinds} AS keyword_types, "
    f"{_coalesce_extract('docs.text', metadata.SUPPLIER_FIELDS['razón_social'])} AS razon_social, {_hits.replace('(text', '(docs.text')} AS patterns_hit "
    "FROM decided_six d JOIN docs ON docs.doc_id = d.doc_id JOIN kw_text ON kw_text.doc_id = d.doc_id"))

# ---------------------------------------------------------------- catalog

SHOWN = f"id, filename, tipo, cuit, proveedor, fecha_documento, monto, {_r('confidence')}"
STRICT = "try_cast(replace(replace(monto, '$', ''), ',', '.') AS DECIMAL(18,2))"
for name, where in {
    "cuit": "cuit LIKE '%30-000001%'", "supplier": "proveedor LIKE '%TELECOM%'", "type": "tipo = 'facturas'",
    "date": "doc_date BETWEEN DATE '1996-03-01' AND DATE '1996-09-30'", "amount": "amount BETWEEN 100000 AND 250000.5",
    "amount_strict": f"{STRICT} BETWEEN 100000 AND 250000.5", "confidence": f"confidence >= {num(0.5)}",
    "combined": f"proveedor LIKE '%EDESUR%' AND tipo = 'facturas' AND confidence >= {num(0.3)} AND doc_date >= DATE '1997-01-01' AND amount >= 50000",
}.items():
    add(f"catalog_search_{name}", f"SELECT {SHOWN} FROM catalog WHERE {where}")
add("catalog_rows", f"SELECT {SHOWN}, proveedor_id, doc_date, CAST(amount AS DOUBLE) AS amount FROM catalog")
add("catalog_page", f"SELECT {SHOWN} FROM catalog ORDER BY catalog.confidence DESC, id LIMIT 50 OFFSET 100")
add("catalog_page_fallback_order", f"SELECT {SHOWN} FROM catalog ORDER BY fecha_procesado, id LIMIT 50 OFFSET 20")
add("catalog_search_page", f"SELECT {SHOWN} FROM catalog WHERE tipo = 'facturas' ORDER BY cuit, id LIMIT 25 OFFSET 10")
add("catalog_search_indexed_cuit", f"SELECT {SHOWN} FROM catalog WHERE cuit LIKE '%30-000001%'")
add("catalog_search_indexed_both", f"SELECT {SHOWN} FROM catalog WHERE tipo = 'facturas' AND proveedor LIKE '%TELECOM%' AND cuit LIKE '%0-0%'")
add("catalog_page_seek", f"SELECT {SHOWN} FROM catalog ORDER BY catalog.confidence DESC, id LIMIT 70 OFFSET 1100")
add("catalog_pages_whole", "SELECT id, (row_number() OVER (ORDER BY filename, id) - 1) // 50 AS page FROM catalog")
add("catalog_search_page_after", f"SELECT {SHOWN} FROM catalog WHERE tipo = 'facturas' ORDER BY cuit NULLS FIRST, id LIMIT 25 OFFSET 50")
add("catalog_by_id", f"SELECT {SHOWN} FROM catalog WHERE id = 1200")
add("cli_search", f"SELECT {SHOWN} FROM catalog WHERE proveedor LIKE '%EDESUR%' AND tipo = 'facturas'")
add("note_hunt", (
    "SELECT id, tipo || '_' || filename AS filename, tipo, proveedor FROM catalog WHERE contains(lower(tipo || '_' || filename), 'nota') "
    "OR contains(lower(filename), 'credit') OR contains(tipo, 'credit') OR contains(tipo, 'debit') ORDER BY id LIMIT 15"))
_number = "CASE WHEN {c} = floor({c}) THEN concat(CAST(CAST({c} AS BIGINT) AS VARCHAR), '.0') ELSE CAST({c} AS VARCHAR) END"
_opening = " || ',' || ".join(
    f"""'"{m}":{{"type":"' || v_{m}.type || '","confidence":' || {_number.format(c=f'v_{m}.confidence')} || '}}'""" for m in METHODS)
add("unknown_preview", (
    f"""SELECT id, filename, tipo, proveedor, left('{{"method_results":{{' || {_opening} || '}}', 100) AS details_preview FROM catalog """
    + " ".join(f"JOIN v_{m} ON v_{m}.doc_id = id" for m in METHODS) + " WHERE tipo = 'desconocido' ORDER BY id LIMIT 10"))

add("supplier_detect_joined", f"SELECT doc_id, supplier_id, {_r('supplier_confidence')} FROM sup")
add("supplier_detect_registry", (
    f"SELECT d.doc_id, arg_min(r.supplier_id, r.ord) AS supplier_id, CASE WHEN count(r.ord) > 0 THEN {num(0.3)} ELSE {num(0.0)} END AS supplier_confidence "
    "FROM docs d LEFT JOIN reg r ON contains(upper(d.text), r.cuit) GROUP BY d.doc_id"))

# ---------------------------------------------------------------- user scorers and rule edits

EXTRA["v_contract_scorer"] = (
    f"SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'contratos' ELSE 'desconocido' END AS type, "
    f"CASE WHEN doc_id % 4 = 0 THEN {num(0.7)} ELSE {num(0.0)} END AS confidence FROM docs", ["docs"])
EXTRA |= _fix_final(vote_ctes(["keyword", "regex", "contract_scorer"], "_own", {"keyword": 0.15, "regex": 0.15, "contract_scorer": 0.4}))
add("ensemble_user_scorer", (
    f"SELECT d.doc_id AS id, tipo, {_r('d.confidence', 'confidence')}, best_consensus, total_methods, 'keyword|regex|contract_scorer' AS methods, "
    f"reasoning, {_r('o.confidence', 'own_confidence')} FROM decided_own d JOIN reasons_own USING (doc_id) JOIN v_contract_scorer o USING (doc_id)"))
EXTRA |= keyword_ctes({**types.TYPE_KEYWORDS, "silos": ["trigo", "SOJA", "depósito"]}, "_edit")
EDITED = [r"\AFACTURA", r"TOTAL\s\$\s\d+\.00\Z", r"CR\xC9DITO", r"(?P<Num>\d{8})-(?P<Digit>\d)$", r"N\S\s[^A-Z\s]+", r"[A-Z]+ARG[A-Z]+"]
EXTRA |= regex_ctes({**{t: p for t, p in patterns.TYPE_PATTERNS.items() if t != "facturas"}, "ediciones": EDITED}, "_edit")
add("rule_edit_keywords", f"SELECT doc_id, type, {_r('confidence')} FROM v_keyword_edit")
add("rule_edit_patterns", f"SELECT doc_id, type, {_r('confidence')} FROM v_regex_edit")
add("review_queue", (
    f"SELECT id, filename, proveedor, {_r('confidence')}, left(texto_extraido, 500) AS preview FROM catalog WHERE tipo = 'desconocido' ORDER BY id LIMIT 30"))
add("review_apply", "SELECT id, filename, tipo FROM reviewed")
add("legacy_merge", (
    "SELECT tipo, is_legacy, count(*) AS n, count(cuit) AS with_cuit, count(proveedor) AS with_supplier FROM ("
    "SELECT tipo, false AS is_legacy, cuit, proveedor FROM catalog UNION ALL SELECT tipo, true, cuit, NULL FROM legacy) GROUP BY 1, 2"))
add("details_parse", (
    "SELECT k.doc_id AS id, CAST(CASE WHEN k.doc_id % 5 = 0 THEN 0 ELSE 4 END AS BIGINT) AS n_methods, "
    "CASE WHEN k.doc_id % 5 <> 0 THEN k.type END AS keyword_type, CASE WHEN k.doc_id % 5 <> 0 THEN round(c.confidence, 6) END AS commercial_confidence "
    "FROM v_keyword k JOIN v_commercial c USING (doc_id)"))
add("stored_path", "SELECT id, concat('output_pdfs/', tipo, '/', filename) AS path FROM catalog")
add("route_collisions", (
    "SELECT doc_id, CASE WHEN first THEN base || '.pdf' WHEN lowest THEN base || '_' || stamp || '.pdf' "
    "ELSE base || '_' || stamp || '_' || doc_id || '.pdf' END AS dest_path FROM (SELECT id AS doc_id, "
    "concat('output_pdfs/', tipo, '/', cuit) AS base, strftime(fecha_procesado, '%Y%m%d_%H%M%S') AS stamp, "
    "row_number() OVER (PARTITION BY tipo, cuit ORDER BY fecha_procesado, id) = 1 AS first, "
    "row_number() OVER (PARTITION BY tipo, cuit, strftime(fecha_procesado, '%Y%m%d_%H%M%S') ORDER BY id) = 1 AS lowest FROM catalog)"))
add("newest_first", "SELECT id, filename, monto FROM catalog WHERE tipo = 'notas_credito'")

# ---------------------------------------------------------------- statistics

add("stats_total", "SELECT count(*) AS total FROM catalog")
add("stats_by_type", "SELECT tipo, count(*) AS n FROM catalog GROUP BY tipo")
add("stats_top_suppliers", (
    "SELECT coalesce(proveedor, 'Sin proveedor') AS proveedor, count(*) AS n FROM catalog GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10"))
add("stats_avg_conf", "SELECT round(coalesce(avg(confidence), 0), 3) AS avg_confidence FROM catalog")
add("stats_avg_conf_all_rows", "SELECT round(sum(confidence) / (count(*) + (SELECT count(*) FROM docs)), 3) AS avg_confidence FROM catalog")
add("stats_avg_conf_by_type", "SELECT tipo, round(avg(confidence), 6) AS avg_confidence FROM catalog GROUP BY tipo")
add("stats_recent", "SELECT count(*) AS recent_documents FROM catalog WHERE fecha_procesado > TIMESTAMP '2001-08-01 12:00:00' - INTERVAL 1 DAY")
add("stats_by_day", "SELECT CAST(fecha_procesado AS DATE) AS day, count(*) AS n FROM catalog GROUP BY 1")
add("stats_by_day_7", "SELECT CAST(fecha_procesado AS DATE) AS day, count(*) AS n FROM catalog GROUP BY 1 ORDER BY day DESC LIMIT 7")
add("stats_overview", (
    "SELECT count(*) AS total_documentos, round(sum(confidence) / count(*), 3) AS confianza_promedio, count(DISTINCT tipo) AS tipos_documento, "
    "count(DISTINCT proveedor_id) AS proveedores_unicos, (SELECT tipo FROM (SELECT tipo, count(*) AS n, max(fecha_procesado) AS latest FROM catalog GROUP BY tipo) "
    "ORDER BY n DESC, latest DESC LIMIT 1) AS tipo_mas_comun FROM catalog"))
add("stats_wide", "SELECT " + ", ".join(
    f"count(*) FILTER (tipo = {lit(t)}) AS count_{t}" for t in [*types.TYPE_KEYWORDS, types.UNKNOWN]) + " FROM catalog")
add("confidence_bands", (
    "SELECT CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM catalog GROUP BY 1"))
add("distinct_types", "SELECT DISTINCT tipo FROM catalog")
add("distinct_suppliers", "SELECT DISTINCT proveedor FROM catalog WHERE proveedor IS NOT NULL")

# ---------------------------------------------------------------- processing

_ext = r"regexp_extract(path, '\.[^./]*$')"
EXTRA["checked"] = (
    f"SELECT *, list_filter([CASE WHEN lower({_ext}) <> '.pdf' THEN 'Extensión no permitida: ' || {_ext} END, "
    "CASE WHEN length < 1024 THEN 'Archivo muy pequeño: ' || length || ' bytes (mínimo: 1024)' END, "
    "CASE WHEN length > 52428800 THEN 'Archivo muy grande: ' || length || ' bytes (máximo: 52428800)' END], lambda x: x IS NOT NULL) AS e1, "
    "list_filter([CASE WHEN page_count < 1 THEN 'Muy pocas páginas: ' || page_count || ' (mínimo: 1)' END, "
    "CASE WHEN page_count > 500 THEN 'Demasiadas páginas: ' || page_count || ' (máximo: 500)' END], lambda x: x IS NOT NULL) AS e2, "
    "list_filter([CASE WHEN needs_pass THEN 'Documento protegido por contraseña' END, "
    "CASE WHEN total_characters < 10 AND pages_with_images = 0 THEN 'No se puede extraer texto y no contiene imágenes' END], lambda x: x IS NOT NULL) AS e3, "
    f"CASE WHEN lower({_ext}) = '.txt' THEN ['Tipo MIME inesperado: text/plain'] ELSE [] END AS w1, "
    "CASE WHEN total_characters < 10 AND pages_with_images > 0 THEN ['Texto mínimo pero contiene imágenes (posible OCR necesario)'] ELSE [] END AS w2 "
    "FROM manifest", ["manifest"])
EXTRA["validated"] = (
    "SELECT *, CASE WHEN len(e1) > 0 THEN 'basic' WHEN len(e2) > 0 THEN 'structure' ELSE 'complete' END AS stage, "
    "CASE WHEN len(e1) > 0 THEN e1 WHEN len(e2) > 0 THEN e2 ELSE e3 END AS errors, len(e1) + len(e2) = 0 AS complete, "
    "len(e1) + len(e2) + len(e3) = 0 AS is_valid FROM checked", ["checked"])
EXTRA["results"] = (
    "SELECT d.doc_id, coalesce(v.is_valid, false) AS success, CASE WHEN NOT coalesce(v.is_valid, false) THEN 'Archivo PDF inválido' END AS error, "
    "CASE WHEN v.is_valid THEN x.tipo END AS classification, CASE WHEN v.is_valid THEN x.confidence ELSE 0 END AS confidence, "
    "CASE WHEN v.is_valid THEN concat('output/', x.tipo, '/', d.filename) END AS destination FROM docs d LEFT JOIN validated v USING (doc_id) "
    "JOIN decided x ON x.doc_id = d.doc_id", ["docs", "validated", "decided"])
add("process_documents", f"SELECT doc_id, success, error, classification, {_r('confidence')}, destination FROM results")
add("batch_summary", (
    "SELECT count(*) AS total_files, count(*) FILTER (success) AS processed, count(*) FILTER (NOT success) AS errors, CAST(0 AS BIGINT) AS skipped FROM results"))
add("batch_summary_by_type", "SELECT classification, count(*) AS n FROM results WHERE success GROUP BY 1")
add("reprocess_unknown", f"SELECT id, tipo, {_r('confidence')} FROM catalog WHERE tipo = 'desconocido'")
add("classification_log", (
    f"SELECT cast(d.doc_id AS string) AS document_path, tipo AS final_classification, {_r('d.confidence', 'final_confidence')}, "
    f"reasoning AS decision_reasoning, {_r('k.confidence', 'keyword_confidence')} FROM decided d JOIN reasons USING (doc_id) JOIN v_keyword k USING (doc_id)"))
add("op_timings", (
    "SELECT op_id, round(epoch_us(max(ts) FILTER (phase = 'end')) / 1e6 - epoch_us(min(ts) FILTER (phase = 'start')) / 1e6, 6) AS duration FROM oplog GROUP BY op_id"))
add("method_performance", (
    f"SELECT method, count(*) AS runs, {_r('avg(CAST(success AS DOUBLE))', 'success_rate')}, {_r('avg(processing_time)', 'mean_time')} FROM oplog GROUP BY method"))

# ---------------------------------------------------------------- Naive Bayes

add("nb_vocabulary", f"SELECT term, {_r('idf')} FROM q_vocab")
add("nb_train", f"SELECT label, term, {_r('log_prob')} FROM q_model")
add("nb_predict", f"SELECT doc_id, type, {_r('confidence')} FROM q_pred")
add("nb_probabilities", f"SELECT doc_id, label, {_r('probability')} FROM q_probs")
add("nb_probability_map", (
    "SELECT doc_id, round(max(probability) FILTER (label = '0'), 6) AS p0, round(max(probability) FILTER (label = '1'), 6) AS p1 FROM q_probs GROUP BY doc_id"))
add("nb_predict_business", f"SELECT doc_id, type, {_r('confidence')} FROM b_pred")
add("nb_top_terms", (
    f"SELECT label, term, {_r('log_prob')}, row_number() OVER (PARTITION BY label ORDER BY log_prob DESC, term) AS position FROM q_model "
    "QUALIFY row_number() OVER (PARTITION BY label ORDER BY log_prob DESC, term) <= 20"))
add("nb_accuracy", (
    "SELECT count(*) AS samples, round(avg(CAST(p.type = s.label AS DOUBLE)), 6) AS accuracy FROM q_pred p JOIN q_test s USING (doc_id)"))
add("nb_class_counts", "SELECT label, count(*) AS n, count(*) < 5 AS too_few FROM q_all GROUP BY label")
add("nb_retrained", f"SELECT label, term, {_r('log_prob')} FROM f_model")
add("nb_split", "SELECT doc_id, label, CASE WHEN NOT few THEN is_test END AS is_test FROM q_flags")
add("nb_feedback_classes", (
    "SELECT label, count(*) AS n, count(*) < 5 AS too_few FROM (SELECT label FROM b_all UNION ALL SELECT tipo FROM last_corr) GROUP BY label"))

# ---------------------------------------------------------------- pages and validation

WS = "' ' || chr(9) || chr(10) || chr(13)"
add("assemble_pages", (
    f"SELECT doc_id, trim(string_agg(chr(10) || '--- Página ' || page_num || ' ---' || chr(10) || text, '' ORDER BY page_num), {WS}) AS text FROM pages_ GROUP BY doc_id"))
add("page_lookup", (
    f"SELECT d.doc_id, trim(p.text, {WS}) AS text FROM (SELECT DISTINCT doc_id FROM pages_) d LEFT JOIN pages_ p ON p.doc_id = d.doc_id AND p.page_num = 3"))
_full = f"length(trim(text, {WS})) > 0"
add("page_profile", (
    f"SELECT *, round(total_characters / total_pages, 6) AS text_density FROM (SELECT doc_id, count(*) AS total_pages, count(*) FILTER ({_full}) AS pages_with_text, "
    f"round(coalesce(avg(length(text)) FILTER ({_full}), 0), 6) AS average_text_length, "
    f"CAST(coalesce(sum(length(text)) FILTER ({_full} AND page_num <= 5), 0) AS BIGINT) AS total_characters, "
    f"count(*) FILTER ({_full} AND page_num <= 5) AS extractable_pages, CAST(coalesce(sum(length(trim(text, {WS}))), 0) AS BIGINT) AS extractable_chars, "
    f"count(*) FILTER ({_full} AND page_num <= 3) > 0 AS has_early_text FROM pages_ GROUP BY doc_id)"))
add("document_info", (
    "SELECT doc_id, count(*) AS page_count, CASE WHEN min_by(role, page_num) = 'user' THEN 'user' END AS author FROM pages_ GROUP BY doc_id"))
add("validate_manifest", (
    "SELECT doc_id, stage, is_valid, complete AND NOT is_valid AS to_quarantine, array_to_string(errors, '|') AS errors, "
    "array_to_string(CASE WHEN complete THEN w1 || w2 ELSE w1 END, '|') AS warnings, complete AND permissions & 4 <> 0 AS may_print, "
    "complete AND permissions & 16 <> 0 AS may_copy FROM validated"))
EXTRA["reports"] = (
    f"SELECT doc_id, lower({_ext}) = '.pdf' AS check_extension, length <= 52428800 AS check_size, page_count > 0 AS check_structure, "
    "has_early_text AS check_content, length, extractable_chars FROM manifest", ["manifest"])
add("validation_report", (
    "SELECT doc_id, check_extension, check_size, check_structure, check_content, check_extension AND check_size AND check_structure AND check_content AS is_valid, "
    "CASE WHEN check_size THEN round(length / 1048576, 2) END AS size_mb, "
    "CASE WHEN check_content AND extractable_chars < 50 THEN 'Poco texto extraíble, podría necesitar OCR' ELSE '' END AS warnings FROM reports"))
add("validation_totals", (
    "SELECT count(*) AS total_files, count(*) FILTER (ok) AS valid_files, count(*) FILTER (NOT ok) AS invalid_files FROM ("
    "SELECT check_extension AND check_size AND check_structure AND check_content AS ok FROM reports)"))
add("validation_errors_by_kind", "SELECT stage, is_valid, count(*) AS n FROM validated GROUP BY 1, 2")
add("quarantine_rows", (
    "SELECT path, '20250925_093940_' || replace(path, '/in/', '') AS quarantine_name, errors[1] AS first_error FROM validated WHERE complete AND NOT is_valid"))
add("quarantine_summary", "SELECT count(*) AS files_in_quarantine FROM validated WHERE complete AND NOT is_valid")
add("input_manifest", "SELECT doc_id, path, length FROM manifest WHERE lower(path) LIKE '%.pdf' AND length <= 52428800")
add("input_status", "SELECT count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes, true AS exists FROM manifest WHERE lower(path) LIKE '%.pdf' AND length <= 52428800")
add("input_merged", "SELECT path, length FROM manifest WHERE lower(path) LIKE '%.pdf'")

# ---------------------------------------------------------------- layout and exports

add("layout_blocks", f"SELECT doc_id, line AS block_id, trim(text) AS text, {_r('x_min')}, {_r('x_max')}, {_r('y_min')}, {_r('y_max')}, zone FROM zoned")
add("layout_zones", (
    "SELECT doc_id, zone, count(*) AS n_blocks, round(count(*) / sum(count(*)) OVER (PARTITION BY doc_id), 6) AS share FROM zoned GROUP BY doc_id, zone"))
add("layout_bounds", "SELECT doc_id, " + ", ".join(
    _r(c) for c in ("x_min", "x_max", "y_min", "y_max", "left_margin", "right_margin", "top_margin", "bottom_margin")) + " FROM bounds")
add("layout_fonts", f"SELECT doc_id, common_size, n_sizes, {_r('mean_size')} FROM fontstats")
add("layout_font_histogram", "SELECT doc_id, size, 'Helvetica' AS font, count(*) AS n_spans FROM spans GROUP BY doc_id, size")
add("layout_tables", "SELECT doc_id, table_words, aligned_blocks, has_table FROM tabled")
add("layout_titles", f"SELECT doc_id, title, size, {_r('position')} FROM titled")
add("layout_scores", "SELECT lay.doc_id, " + ", ".join(_r(f"score_{t}") for t in layout.TYPES) + (
    f", v.type AS best_match, {_r('v.confidence')} FROM lay JOIN v_layout v USING (doc_id)"))
_joined = "FROM catalog c " + " ".join(f"JOIN v_{m} {m} ON {m}.doc_id = c.id" for m in METHODS)
add("export_flat", (
    "SELECT c.id, c.tipo, " + ", ".join(f"{m}.type AS method_{m}_type, {_r(f'{m}.confidence', f'method_{m}_confidence')}" for m in METHODS)
    + f", d.best_consensus AS consensus_best, d.strong AS consensus_strong {_joined} JOIN decided d ON d.doc_id = c.id"))
add("export_methods_long", (
    f"SELECT v.doc_id AS documento_id, v.method AS metodo, v.type AS tipo_predicho, {_r('v.confidence', 'confianza')}, d.tipo AS tipo_final "
    "FROM votes v JOIN decided d USING (doc_id)"))
add("export_filtered", (
    "SELECT id, filename, monto FROM catalog WHERE tipo = 'facturas' AND proveedor_id = 'edesur' AND fecha_procesado >= TIMESTAMP '1996-01-01'"))
add("export_csv_roundtrip", "SELECT c.id, c.tipo, k.type AS method_keyword_type, c.monto FROM catalog c JOIN v_keyword k ON k.doc_id = c.id")
add("export_json_roundtrip", "SELECT c.id, c.tipo, c.monto, d.best_consensus FROM catalog c JOIN decided d ON d.doc_id = c.id")
add("export_xml_roundtrip", "SELECT id, tipo, monto, CAST(4 AS BIGINT) AS n_methods FROM catalog")
add("export_metadata", (
    "SELECT '2001-08-01T12:00:00' AS export_date, count(*) AS total_records, 'json' AS format, '1.0' AS version, true AS success "
    "FROM catalog WHERE tipo = 'remitos'"))
SQL["stream_ingest"] = SQL["process_documents"]
add("stream_quarantine", (
    "SELECT path, '20250925_093940_' || replace(path, '/in/', '') AS quarantine_name, errors[1] AS first_error FROM validated "
    "WHERE complete AND NOT is_valid AND doc_id IN (SELECT doc_id FROM docs)"))
add("export_searched", "SELECT id, tipo, monto FROM catalog WHERE proveedor LIKE '%EDESUR%' AND tipo = 'facturas' AND amount >= 50000")
add("catalog_appended", f"SELECT tipo, count(*) AS n, {_r('avg(confidence)', 'avg_confidence')} FROM catalog GROUP BY tipo")
add("registry_saved", "SELECT supplier_id, name, cuit FROM reg")
SQL["nb_model_saved"] = SQL["nb_top_terms"]
SQL["stream_daily_counts"] = "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"

_windows = ("SELECT (CAST(floor(epoch(ts)) AS BIGINT) // 21600 + k) * 21600 AS until_s, event_type, count(*) AS n FROM events, "
            "(SELECT unnest([1, 2, 3, 4]) AS k) GROUP BY 1, 2")
SQL["stream_recent"] = SQL["recent_windows"] = _windows
add("input_rejected", (
    "SELECT doc_id, path, length, CASE WHEN lower(path) NOT LIKE '%.pdf' THEN 'extension' ELSE 'size' END AS reason FROM manifest "
    "WHERE lower(path) NOT LIKE '%.pdf' OR length > 52428800"))
add("input_new", "SELECT doc_id, path, length FROM manifest WHERE doc_id % 5 = 0 OR doc_id % 7 = 0")
SQL["content_hashes"] = (
    "SELECT path, length, CASE WHEN length <= 5000 THEN sha256(body) END AS sha256, CASE WHEN length <= 5000 THEN size ELSE 0 END AS bytes_read, "
    "length <= 5000 AND length = size AS complete FROM (SELECT concat('/in/', page_id) AS path, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS size, "
    "strlen(coalesce(html, '')) + CAST(page_id % 11 = 0 AS BIGINT) AS length FROM pages)")
EXTRA["profile_"] = (
    f"SELECT doc_id, count(*) AS pages, CAST(coalesce(sum(length(text)) FILTER ({_full} AND page_num <= 5), 0) AS BIGINT) AS chars, min_by(role, page_num) AS author "
    "FROM pages_ GROUP BY doc_id", ["pages_"])
add("validate_profiled", (
    "SELECT doc_id, stage, stage = 'complete' AND len(e) = 0 AS is_valid, stage = 'complete' AND len(e) > 0 AS to_quarantine, array_to_string(e, '|') AS errors, "
    "pages AS page_count, author, pages AS counted_pages FROM (SELECT doc_id, pages, author, CASE WHEN chars * 8 < 1024 THEN 'basic' ELSE 'complete' END AS stage, "
    "CASE WHEN chars * 8 < 1024 THEN ['Archivo muy pequeño: ' || chars * 8 || ' bytes (mínimo: 1024)'] ELSE list_filter(["
    "CASE WHEN doc_id % 13 = 0 THEN 'Documento protegido por contraseña' END, CASE WHEN chars < 10 THEN 'No se puede extraer texto y no contiene imágenes' END, "
    "CASE WHEN doc_id % 11 = 0 THEN 'Inconsistencia en el tamaño del archivo durante lectura' END], lambda x: x IS NOT NULL) END AS e FROM profile_)"))
add("catalog_created", "SELECT tipo, count(*) AS n, count(cuit) AS with_cuit, max(doc_date) AS latest FROM catalog GROUP BY tipo")
add("review_merged", "SELECT id, filename, tipo FROM reviewed")
add("catalog_search_clustered", f"SELECT {SHOWN} FROM catalog WHERE tipo = 'facturas' AND doc_date BETWEEN DATE '1996-03-01' AND DATE '1996-03-20'")
add("export_several", (
    f"SELECT f.format, c.n AS total_records, c.n AS read FROM (SELECT unnest(['csv', 'json', 'xml']) AS format) f, "
    f"(SELECT count(*) AS n FROM catalog WHERE proveedor LIKE '%TELECOM%' AND confidence >= {num(0.2)}) c"))
add("registry_json", "SELECT supplier_id, CAST(ord AS BIGINT) AS ord, name, cuit, 'facturas' AS doc_type, upper(name) AS terms, 0.25e0 AS confidence_boost FROM reg")
_votes_six = ", ".join(f"v_{m}.type AS {m}_type, {_r(f'v_{m}.confidence', f'{m}_confidence')}" for m in [*METHODS, "ml", "layout"])
EXTRA["structured"] = (
    "SELECT doc_id, (CAST(has_header AS INT) + CAST(has_table AS INT) + CAST(has_totals AS INT) + CAST(tax_compliant AS INT)) / 4e0 AS structure_score "
    f"FROM (SELECT doc_id, {_any(patterns.HEADER_PATTERNS, 'm')} AS has_header, {_any(patterns.TABLE_PATTERNS, 'i')} AS has_table, "
    f"{_any(patterns.TOTAL_PATTERNS, 'i')} AS has_totals, ({_tax}) >= 2 AS tax_compliant FROM docs)", ["docs"])
add("full_analysis_details", (
    f"SELECT d.doc_id, d.tipo, {_r('d.confidence', 'confidence')}, sup.supplier_id, r.reasoning, {_votes_six}, {_r('st.structure_score', 'structure_score')}, "
    f"{_r('p.confidence', 'ml_probability')}, {_r('lay.confidence0', 'layout_score')}, (SELECT count(*) FROM spans s WHERE s.doc_id = d.doc_id) AS total_blocks "
    "FROM decided_six d JOIN reasons_six r ON r.doc_id = d.doc_id JOIN sup ON sup.doc_id = d.doc_id JOIN structured st ON st.doc_id = d.doc_id "
    "JOIN b_pred p ON p.doc_id = d.doc_id JOIN lay ON lay.doc_id = d.doc_id " + " ".join(f"JOIN v_{m} ON v_{m}.doc_id = d.doc_id" for m in [*METHODS, "ml", "layout"])))
