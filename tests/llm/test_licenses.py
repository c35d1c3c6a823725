import math
from collections import Counter

import pytest

from legajo.llm import licenses as lic

SCHEMA = "path string, text string"
FILES = [
    ("LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/LICENSE.txt", "x\nReleased under the MIT License.\n"), ("a/b/c/f.py", "code\ncode"),
    ("a/b/COPYING", "no licence in it"), ("d/f.py", "nothing"), ("d/e/g.py", "# Licensed under CC BY-NC 4.0."), ("top.txt", None), ("a/b/notice-2", "All rights reserved."),
    ("a/licence", "This work is licensed under the GNU General Public License, version 3."), (None, "Released under the MIT License."), (None, "z"), ("d/f.py", "nothing"), ("", ""),
]


def brute_scan(files):
    n = len(files)
    vocabulary = {w for _, t in lic.TEMPLATES for w in lic.words(t)}
    df = Counter(w for _, t in files for w in vocabulary & set(lic.words(t or "")))
    idf = lambda w: math.log((1 + n) / (1 + df[w])) + 1 if w in vocabulary else math.log(1 + n) + 1
    vec = lambda t: {w: c * idf(w) for w, c in lic.words(t).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = []
    for path, text in files:
        best = (None, 0.0, -1)
        for k, line in enumerate((text or "").split("\n")):
            v = vec(line)
            for name, t in sorted(lic.TEMPLATES):
                s = sum(x * vec(t).get(w, 0) for w, x in v.items()) / (norm(v) * norm(vec(t))) if v else 0
                if s > best[1] + 1e-12:
                    best = (name, min(s, 1.0), k)
        out.append((path, *best))
    return out


def brute_inherit(found, at_least=0.8):
    own = [(p, lic_, s) if s >= at_least else (p, None, s) for p, lic_, s, _ in found]
    granted = {}
    for p, name, s in own:
        if p is not None and name:
            d, _, f = p.rpartition("/")
            if f.lower().startswith(("license", "licence", "copying", "notice")):
                granted[d] = min(granted.get(d, (1, "")), (-s, name))
    out = []
    for p, name, _ in own:
        at, where = None, None
        if p is not None:
            d = p.rpartition("/")[0]
            while True:
                if d in granted:
                    at, where = granted[d][1], d
                    break
                if not d:
                    break
                d = d.rpartition("/")[0]
        out.append((p, name or at, "header" if name else "directory" if at else None, None if name else where))
    return sorted(out, key=str)


def test_scan_and_inheritance(spark):
    files = spark.createDataFrame([(*f, "x") for f in FILES], SCHEMA + ", score string")
    found = lic.scanned(files)
    want = brute_scan(FILES)
    got = sorted(map(tuple, found.collect()), key=str)
    assert [(p, n, k) for p, n, _, k in got] == [(p, n, k) for p, n, _, k in sorted(want, key=str)]
    assert [s for _, _, s, _ in got] == pytest.approx([s for _, _, s, _ in sorted(want, key=str)])
    out = lic.inherited(found).collect()
    assert sorted(((r.path, r.effective, r.source, r.from_dir) for r in out), key=str) == brute_inherit(want)


def test_documents(spark, sf):
    from legajo.llm.queries import op6_licence_scan

    out = op6_licence_scan(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(out) == len(docs)
    for r in out:
        lines = docs[r.doc_id].split("\n")
        named = [n for n, t in lic.TEMPLATES if t in lines]
        assert (r.score > 0.999 and r.licence in named) if named else r.source != "header"


def test_empty(spark):
    assert lic.inherited(lic.scanned(spark.createDataFrame([], SCHEMA))).collect() == []
