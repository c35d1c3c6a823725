"""Expected results as SQL, written from the same rule values by other means.

Each statement is a chain of common table expressions over the raw tables. Votes are grouped and ranked
here, where the engine compares columns, and every rule is evaluated without any prior scan.
"""

from __future__ import annotations

import re

from legajo.rules import agro, commercial, ensemble, layout, metadata, patterns, suppliers, training, types
from legajo.rules import catalog as cat
from legajo.sources.tables import BUSINESS_DOCS_SQL


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def num(value: float) -> str:
    return f"CAST({value!r} AS DOUBLE)"


def rx(pattern: str, flags: str = "i") -> str:
    """RE2 form: letters beyond ASCII in \\w, no newline in '.'."""
    p = re.sub(r"(?<!\[)\\w", r"[\\p{L}\\p{N}_]", pattern).replace("\\Z", "\\z")
    return lit(f"(?{flags}-s){p}")


def first_max(columns: dict[str, str]) -> str:
    top = f"greatest({', '.join(columns)})"
    whens = " ".join(f"WHEN {c} = {top} THEN {lit(t)}" for c, t in columns.items())
    return f"CASE {whens} END"


def count_of(text: str, term: str) -> str:
    return f"((length({text}) - length(replace({text}, {lit(term)}, ''))) / {len(term)})"


def chain(parts: list[str]) -> str:
    return " + ".join(["CAST(0 AS DOUBLE)", *parts])


def flag(test: str, points: float) -> str:
    return f"CASE WHEN {test} THEN {num(points)} ELSE {num(0.0)} END"


# ---------------------------------------------------------------- scorers


def keyword_ctes(rules=types.TYPE_KEYWORDS, s: str = "") -> dict[str, tuple[str, list[str]]]:
    scores = []
    for i, words in enumerate(rules.values()):
        words = [w.lower() for w in words]
        parts = [f"({count_of('t', k)} * {num(0.1)} + {flag(f'contains(op, {lit(k)})', 0.3)})" for k in words]
        scores.append(f"least({chain(parts)}, {num(1.0)}) AS k{i}")
    columns = {f"k{i}": t for i, t in enumerate(rules)}
    top = f"greatest({', '.join(columns)})"
    return {
        f"kw_text{s}": (
            "SELECT doc_id, lower(text) AS t, array_to_string(list_filter(regexp_split_to_array("
            r"trim(lower(text), ' ' || chr(9) || chr(10) || chr(13)), '\s+'), lambda x: x <> '')[1:100], ' ') AS op "
            "FROM docs", ["docs"]),
        f"kw_scores{s}": (f"SELECT doc_id, t, {', '.join(scores)} FROM kw_text{s}", [f"kw_text{s}"]),
        f"v_keyword{s}": (
            f"SELECT doc_id, CASE WHEN {top} < {num(0.7)} THEN 'desconocido' ELSE {first_max(columns)} END AS type, "
            f"{top} AS confidence FROM kw_scores{s}", [f"kw_scores{s}"]),
    }


def regex_ctes(rules=patterns.TYPE_PATTERNS, s: str = "") -> dict[str, tuple[str, list[str]]]:
    scores = []
    for i, exprs in enumerate(rules.values()):
        parts = [f"least(len(regexp_extract_all(text, {rx(p, 'im')})), 3)" for p in exprs]
        scores.append(f"least(({' + '.join(parts)}) / {num(3.0 * len(exprs))}, {num(1.0)}) AS r{i}")
    columns = {f"r{i}": t for i, t in enumerate(rules)}
    top = f"greatest({', '.join(columns)})"
    return {
        f"rx_scores{s}": (f"SELECT doc_id, {', '.join(scores)} FROM docs", ["docs"]),
        f"v_regex{s}": (
            f"SELECT doc_id, CASE WHEN {top} = 0 THEN 'desconocido' ELSE {first_max(columns)} END AS type, "
            f"{top} AS confidence FROM rx_scores{s}", [f"rx_scores{s}"]),
    }


def _present(rules, element: str) -> str:
    return "(" + " OR ".join(f"regexp_matches(t, {rx(p)})" for p in rules.ELEMENTS[element]) + ")"


def domain_ctes(name: str, rules) -> dict[str, tuple[str, list[str]]]:
    scores = []
    for i, spec in enumerate(rules.TYPES.values()):
        kw = chain([flag(f"contains(t, {lit(k)})", rules.POINTS_KEYWORD) for k in spec["keywords"]])
        pat = chain([f"{num(rules.POINTS_MATCH)} * len(regexp_extract_all(t, {rx(p)}))" for p in spec["patterns"]])
        req = chain([flag(f"e_{_id(e)}", rules.POINTS_REQUIRED) for e in spec["required"]])
        n = len(spec["required"])
        found = " + ".join(f"CAST(e_{_id(e)} AS INT)" for e in spec["required"])
        scores.append(
            f"least((({kw}) + ({pat}) + ({req})) * ({num(0.5)} + {num(0.5)} * (({found}) / {num(float(n))})), {num(1.0)}) AS s{i}")
    elements = ", ".join(f"{_present(rules, e)} AS e_{_id(e)}" for e in rules.ELEMENTS)
    bonus = []
    for _, points, whole, terms in rules.BONUS:
        for term in terms:
            test = f"regexp_matches(t, {lit(chr(92) + 'b' + term + chr(92) + 'b')})" if whole else f"contains(t, {lit(term)})"
            bonus.append(flag(test, points))
    columns = {f"s{i}": t for i, t in enumerate(rules.TYPES)}
    top = f"greatest({', '.join(columns)})"
    return {
        f"{name}_elements": (f"SELECT doc_id, t, {elements} FROM (SELECT doc_id, lower(text) AS t FROM docs)", ["docs"]),
        f"{name}_scores": (
            f"SELECT doc_id, {', '.join(scores)}, least({chain(bonus)}, {num(rules.BONUS_LIMIT)}) AS bonus FROM {name}_elements",
            [f"{name}_elements"]),
        f"v_{name}": (
            f"SELECT doc_id, CASE WHEN {top} = 0 THEN 'desconocido' ELSE {first_max(columns)} END AS type, "
            f"CASE WHEN {top} = 0 THEN {num(0.0)} ELSE least({top} + bonus, {num(1.0)}) END AS confidence FROM {name}_scores",
            [f"{name}_scores"]),
    }


def _id(name: str) -> str:
    return name.replace("ó", "o").replace("é", "e")


def supplier_ctes() -> dict[str, tuple[str, list[str]]]:
    scores, columns = [], {}
    for i, s in enumerate(suppliers.SUPPLIERS):
        exact = " OR ".join(f"contains(u, {lit(n)})" for n in s["names"])
        partial = [
            "(" + " + ".join(f"CAST(contains(u, {lit(w)}) AS INT)" for w in n.split()) + ") >= 2"
            for n in s["names"] if len(n) > 10 and len(n.split()) >= 2
        ]
        name = f"CASE WHEN {exact} THEN {num(0.4)} "
        name += f"WHEN {' OR '.join(partial)} THEN {num(0.3)} " if partial else ""
        name += f"ELSE {num(0.0)} END"
        shares = []
        for _, terms, indicators, _ in s["patterns"]:
            share = []
            for words, points in ((terms, 0.2), (indicators, 0.1)):
                hits = " + ".join(f"CAST(contains(u, {lit(w)}) AS INT)" for w in words)
                share.append(f"(({hits}) / {num(float(len(words)))}) * {num(points)}")
            shares.append(" + ".join(share))
        tax = lit(s["cuit"])
        scores.append(
            f"least(({name}) + {flag(f'contains(u, {tax})', 0.3)} + greatest({num(0.0)}, {', '.join(shares)}), {num(1.0)}) AS p{i}")
        columns[f"p{i}"] = s["supplier_id"]
    top = f"greatest({', '.join(columns)})"
    boosts = ", ".join(
        f"({lit(s['supplier_id'])}, {lit(t)}, {num(b)})" for s in suppliers.SUPPLIERS for t, _, _, b in s["patterns"])
    return {
        "sup_scores": (f"SELECT doc_id, {', '.join(scores)} FROM (SELECT doc_id, upper(text) AS u FROM docs)", ["docs"]),
        "sup": (
            f"SELECT doc_id, CASE WHEN {top} >= {num(0.3)} THEN {first_max(columns)} END AS supplier_id, "
            f"CASE WHEN {top} >= {num(0.3)} THEN {top} ELSE {num(0.0)} END AS supplier_confidence FROM sup_scores",
            ["sup_scores"]),
        "boosts": (f"SELECT * FROM (VALUES {boosts}) b(supplier_id, type, boost)", []),
    }


# ---------------------------------------------------------------- votes and decision


def vote_ctes(methods: list[str], suffix: str = "", own: dict[str, float] | None = None) -> dict[str, tuple[str, list[str]]]:
    """``own``: weights in their order, of methods that report in the given order."""
    given = own or ensemble.WEIGHTS
    weights, order = list(given), methods if own else ensemble.RUN_ORDER
    union = " UNION ALL ".join(
        f"SELECT doc_id, {lit(m)} AS method, {order.index(m)} AS run, {weights.index(m)} AS pos, "
        f"{num(given[m])} AS weight, type, confidence FROM v_{m}" for m in methods)
    s = suffix
    both = {m: m in methods for m in ("agro", "commercial")}
    route = "CASE " if any(both.values()) else "CASE WHEN false THEN '' "
    if both["agro"]:
        route += f"WHEN a.confidence >= {num(0.9)} THEN 'agro' "
    if both["commercial"]:
        route += f"WHEN c.confidence >= {num(0.9)} THEN 'commercial' "
    route += "ELSE 'vote' END"
    joins = ("LEFT JOIN v_agro a USING (doc_id) " if both["agro"] else "") + (
        "LEFT JOIN v_commercial c USING (doc_id) " if both["commercial"] else "")
    domain_type = {"agro": "a.type", "commercial": "c.type"}
    types_ = "".join(f"WHEN {route} = '{m}' THEN {domain_type[m]} " for m in both if both[m])
    confs = (f"WHEN {route} = 'agro' THEN least(a.confidence * {num(0.25)} + {num(0.3)}, {num(1.0)}) " if both["agro"] else "") + (
        f"WHEN {route} = 'commercial' THEN least(c.confidence * {num(0.22)} + {num(0.25)}, {num(1.0)}) " if both["commercial"] else "")
    reasons = ""
    for m, word in (("agro", "agropecuario"), ("commercial", "comercial")):
        if both[m]:
            reasons += (f"WHEN route = '{m}' THEN 'Documento {word} detectado con alta confianza (' || "
                        f"printf('%.3f', {m}_confidence) || ') - prioridad automática' ")
    deps = [f"v_{m}" for m in methods]
    return {
        f"votes{s}": (union, deps),
        f"active{s}": (f"SELECT * FROM votes{s} WHERE confidence > {num(0.1)}", [f"votes{s}"]),
        f"stats{s}": (
            "SELECT doc_id, type, count(*) AS vote_count, sum(confidence ORDER BY run) / count(*) AS avg_confidence, "
            "max(confidence) AS max_confidence, min(run) AS first_run, string_agg(method, '|' ORDER BY run) AS methods, "
            "count(*) / sum(count(*)) OVER (PARTITION BY doc_id) AS share, "
            f"sum(count(*)) OVER (PARTITION BY doc_id) AS total FROM active{s} GROUP BY doc_id, type", [f"active{s}"]),
        f"best{s}": (
            f"SELECT *, vote_count >= 2 AND avg_confidence >= {num(0.5)} AS strong FROM stats{s} QUALIFY row_number() OVER "
            "(PARTITION BY doc_id ORDER BY vote_count DESC, avg_confidence DESC, first_run) = 1", [f"stats{s}"]),
        f"scores{s}": (
            "SELECT doc_id, type, sum(confidence * weight ORDER BY pos) AS score, min(pos) AS pos "
            f"FROM votes{s} WHERE confidence > 0 GROUP BY doc_id, type", [f"votes{s}"]),
        f"lead{s}": (
            f"SELECT s.doc_id, s.type, coalesce(b.boost, {num(0.0)}) AS boost FROM (SELECT * FROM scores{s} QUALIFY row_number() "
            "OVER (PARTITION BY doc_id ORDER BY score DESC, pos) = 1) s LEFT JOIN sup ON sup.doc_id = s.doc_id "
            "LEFT JOIN boosts b ON b.supplier_id = sup.supplier_id AND b.type = s.type", [f"scores{s}", "sup", "boosts"]),
        f"final{s}": (
            f"SELECT s.doc_id, s.type, s.score + CASE WHEN l.type = s.type THEN l.boost ELSE {num(0.0)} END "
            f"+ CASE WHEN b.strong AND b.type = s.type THEN {num(0.1)} * b.share ELSE {num(0.0)} END AS score, s.pos, "
            f"coalesce(b.strong, false) AS strong, l.boost, CASE WHEN b.strong THEN {num(0.1)} * b.share ELSE {num(0.0)} END AS factor "
            f"FROM scores{s} s JOIN lead{s} l USING (doc_id) LEFT JOIN best{s} b ON b.doc_id = s.doc_id "
            "QUALIFY row_number() OVER (PARTITION BY s.doc_id ORDER BY 3 DESC, s.pos) = 1".replace("ORDER BY 3", "ORDER BY score_"),
            [f"scores{s}", f"lead{s}", f"best{s}"]),
        f"decided{s}": (
            f"SELECT d.doc_id, {route} AS route, CASE {types_}WHEN coalesce(capped, 0) < {num(0.15)} THEN 'desconocido' ELSE f.type END AS tipo, "
            f"CASE {confs}WHEN coalesce(capped, 0) < {num(0.15)} THEN {num(0.0)} ELSE capped END AS confidence, "
            f"CASE WHEN {route} = 'vote' THEN coalesce(f.boost, {num(0.0)}) ELSE {num(0.0)} END AS supplier_boost, "
            f"CASE WHEN {route} = 'vote' THEN coalesce(f.factor, {num(0.0)}) ELSE {num(0.0)} END AS consensus_factor, "
            f"b.type AS best_consensus, coalesce(b.strong, false) AS strong, coalesce(b.total, 0) AS total_methods, "
            f"b.vote_count, f.doc_id IS NOT NULL AS scored, "
            + ("a.confidence" if both["agro"] else "NULL") + " AS agro_confidence, "
            + ("c.confidence" if both["commercial"] else "NULL") + " AS commercial_confidence "
            f"FROM docs d {joins}LEFT JOIN (SELECT *, CASE WHEN NOT strong AND least(score, {num(1.0)}) > {num(0.7)} "
            f"THEN least(score, {num(1.0)}) * {num(0.9)} ELSE least(score, {num(1.0)}) END AS capped FROM final{s}) f ON f.doc_id = d.doc_id "
            f"LEFT JOIN best{s} b ON b.doc_id = d.doc_id", ["docs", f"final{s}", f"best{s}", *deps]),
        f"reasons{s}": (
            f"SELECT d.doc_id, CASE {reasons}WHEN NOT scored THEN '' ELSE concat_ws(' | ', "
            "CASE WHEN g.agreeing IS NOT NULL THEN 'Métodos coincidentes: ' || g.agreeing END, "
            "CASE WHEN strong THEN 'Consenso fuerte: ' || vote_count || ' métodos coinciden' END, "
            "'Proveedor detectado: ' || sup.supplier_id, "
            f"CASE WHEN d.confidence >= {num(0.8)} THEN 'Alta confianza' WHEN d.confidence >= {num(0.15)} THEN 'Confianza media' "
            "ELSE 'Baja confianza' END || ' (' || printf('%.3f', d.confidence) || ')') END AS reasoning "
            f"FROM decided{s} d LEFT JOIN sup USING (doc_id) LEFT JOIN (SELECT a.doc_id, "
            "string_agg(a.method || ' (' || printf('%.2f', a.confidence) || ')', ', ' ORDER BY a.run) AS agreeing "
            f"FROM active{s} a JOIN decided{s} x ON x.doc_id = a.doc_id AND x.tipo = a.type GROUP BY a.doc_id) g USING (doc_id)",
            [f"decided{s}", f"active{s}", "sup"]),
    }


def _fix_final(ctes: dict) -> dict:
    """Name the boosted score before it is ranked."""
    for key, (sql, deps) in list(ctes.items()):
        if key.startswith("final"):
            sql = sql.replace("END AS score, s.pos", "END AS score_, s.pos")
            ctes[key] = (f"SELECT doc_id, type, score_ AS score, pos, strong, boost, factor FROM ({sql})", deps)
    return ctes


# ---------------------------------------------------------------- metadata and catalog


def _coalesce_extract(text: str, exprs: list[str], flags: str = "i", group: int = 1) -> str:
    return "coalesce(" + ", ".join(
        f"nullif(trim(regexp_extract({text}, {rx(p, flags)}, {group}), ' ' || chr(9) || chr(10) || chr(13)), '')" for p in exprs) + ")"


def meta_ctes() -> dict[str, tuple[str, list[str]]]:
    dates = " || ".join(f"regexp_extract_all(text, {rx(p)})" for p in metadata.DATES)
    line = _coalesce_extract("trim(x)", metadata.SUPPLIER_LINE)
    number = _coalesce_extract("text", metadata.DOCUMENT_NUMBER)
    months = " ".join(f"WHEN {lit(m)} THEN {i + 1}" for i, m in enumerate(metadata.MONTHS))
    digits = r"regexp_replace(monto, '[^\d.,]', '', 'g')"
    amount = (
        f"CASE WHEN contains({digits}, ',') AND contains({digits}, '.') THEN CASE WHEN instr(reverse({digits}), ',') < instr(reverse({digits}), '.') "
        f"THEN replace(replace({digits}, '.', ''), ',', '.') ELSE replace({digits}, ',', '') END "
        f"WHEN regexp_full_match({digits}, '\\d{{1,3}}(,\\d{{3}})+') THEN replace({digits}, ',', '') "
        f"WHEN regexp_full_match({digits}, '\\d{{1,3}}(\\.\\d{{3}})+') THEN replace({digits}, '.', '') "
        f"ELSE replace({digits}, ',', '.') END"
    )
    return {
        "meta": (
            f"SELECT doc_id, nullif(regexp_extract(text, {rx(metadata.TAX_ID, 'm')}), '') AS cuit, "
            f"list_filter(found, lambda x, i: list_position(found, x) = i) AS dates, regexp_extract_all(text, {rx(metadata.AMOUNT, 'm')}) AS amounts, "
            f"list_filter(list_transform(string_split(text, chr(10))[1:10], lambda x: {line}), lambda x: x IS NOT NULL)[1] AS supplier, "
            f"{number} AS document_number FROM (SELECT *, {dates} AS found FROM docs)", ["docs"]),
        "catalog": (
            "SELECT c.*, coalesce(try_strptime(replace(fecha_documento, '-', '/'), '%d/%m/%Y'), "
            "try_strptime(replace(fecha_documento, '-', '/'), '%Y/%m/%d'))::DATE AS doc_date, "
            f"try_cast({amount} AS DECIMAL(18,2)) AS amount FROM ("
            "SELECT d.doc_id AS id, d.filename, x.tipo, m.cuit, m.supplier AS proveedor, sup.supplier_id AS proveedor_id, "
            "m.dates[1] AS fecha_documento, m.amounts[1] AS monto, x.confidence, d.processed_at AS fecha_procesado, "
            "d.text AS texto_extraido FROM docs d JOIN decided x USING (doc_id) JOIN meta m USING (doc_id) JOIN sup USING (doc_id)) c",
            ["docs", "decided", "meta", "sup"]),
    }


DOCS_SQL = BUSINESS_DOCS_SQL.format(orders="orders", customer="customer", lineitem="lineitem")


def all_ctes() -> dict[str, tuple[str, list[str]]]:
    ctes: dict[str, tuple[str, list[str]]] = {"docs": (DOCS_SQL, [])}
    ctes |= keyword_ctes() | regex_ctes() | domain_ctes("agro", agro) | domain_ctes("commercial", commercial)
    ctes |= supplier_ctes() | meta_ctes()
    ctes |= _fix_final(vote_ctes(["keyword", "regex", "agro", "commercial"]))
    ctes |= _fix_final(vote_ctes(["keyword", "regex"], "_two"))
    return ctes


CTES = all_ctes()


def statement(body: str, extra: dict[str, tuple[str, list[str]]] | None = None) -> str:
    """``body`` with the common table expressions it names, directly or through others."""
    known = {**CTES, **(extra or {})}
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in known[name][1]:
            visit(dep)
        order.append(name)

    for name in known:
        if re.search(rf"\b{name}\b", body):
            visit(name)
    if not order:
        return body
    ctes = ", ".join(f"{n} AS MATERIALIZED ({known[n][0]})" for n in order)
    return f"WITH {ctes} {body}"
