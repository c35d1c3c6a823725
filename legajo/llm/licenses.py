"""Licence scan: TF-IDF cosine of lines and licence files to templates, and inheritance down the directory tree."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legajo.llm.common import checked, map_arrow, stored

# Header sentences of common licences, as their authors recommend them.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("proprietary", "All rights reserved."),
]
#: Names of files whose licence holds for their directory and all below it.
LICENCE_FILES = r"(?i)^(licen[cs]e|copying|notice)([.\-_].*)?$"
WORD = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")


def words(text: str) -> Counter[str]:
    return Counter(WORD.findall(text.lower()))


class Scanner:
    """Sparse TF-IDF vectors of the templates. Words of no template weigh as much as a word that no text has."""

    def __init__(self, templates: list[tuple[str, str]], texts: int, frequency: dict[str, int]) -> None:
        self.unseen = math.log(1 + texts) + 1
        self.idf = {w: math.log((1 + texts) / (1 + frequency.get(w, 0))) + 1 for _, t in templates for w in words(t)}
        self.templates = [name for name, _ in templates]
        self.entries: dict[str, list[tuple[int, float]]] = {}  # word: templates that have it, with its share of them
        for k, (_, t) in enumerate(templates):
            own, size = self.vector(words(t))
            for w, x in own.items():
                self.entries.setdefault(w, []).append((k, x / size))

    def vector(self, count: Counter[str]) -> tuple[dict[str, float], float]:
        """Weights of the words that templates have, and the length of the whole vector."""
        own = {w: n * self.idf[w] for w, n in count.items() if w in self.idf}
        rest = sum(n * n for w, n in count.items() if w not in self.idf) * self.unseen**2
        return own, math.sqrt(sum(x * x for x in own.values()) + rest)

    def best(self, line: str) -> tuple[str | None, float]:
        """The template of highest cosine, ties to the first by name; none for a line that shares no word."""
        own, size = self.vector(words(line))
        sums: dict[int, float] = {}
        for w, x in own.items():
            for k, share in self.entries[w]:
                sums[k] = sums.get(k, 0.0) + x * share
        if not sums:
            return None, 0.0
        score, name = min((-x, self.templates[k]) for k, x in sums.items())
        return name, min(-score / size, 1.0)

    def scan(self, text: str | None) -> tuple[str | None, float, int]:
        """Licence, cosine and line number (from 0) of the text's best line; the first of equal ones."""
        found: tuple[str | None, float, int] = (None, 0.0, -1)
        for n, line in enumerate((text or "").split("\n")):
            name, score = self.best(line)
            if score > found[1]:
                found = (name, score, n)
        return found


def scanned(files: DataFrame, text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, id_cols: tuple[str, ...] = ("path",)) -> DataFrame:
    """``id_cols`` with ``licence, score, line``: the template nearest to any line of the whole text, and its cosine.

    Document frequencies of the templates' words are counted over all texts first. Null and empty texts have no
    licence and score 0.
    """
    checked(files, text_col, *id_cols)
    vocabulary = {w for _, t in templates for w in words(t)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for b in batches:
            for t in b.column(0):
                seen.update(vocabulary.intersection(WORD.findall((t.as_py() or "").lower())))
                seen[""] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    totals = map_arrow(files.select(text_col), "word string, n long", count).groupBy("word").agg(F.sum("n").alias("n")).collect()
    frequency = {r["word"]: r["n"] for r in totals}  # one row for each word of the templates
    rows = files.select(*id_cols, F.col(text_col).alias("_text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, frequency.get("", 0), frequency)
        for b in batches:
            found = [scanner.scan(t.as_py()) for t in b.column(len(id_cols))]
            yield pa.RecordBatch.from_arrays([
                *[b.column(i) for i in range(len(id_cols))], pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.int64()),
            ], [*id_cols, "licence", "score", "line"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in id_cols)
    return map_arrow(rows, schema + ", licence string, score double, line long", work)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"(^|/)[^/]*$", "")


def inherited(found: DataFrame, at_least: float = 0.8) -> DataFrame:
    """``found`` (with ``path, licence, score``) and ``effective``, ``source``, ``from_dir``.

    A file's own licence (cosine ``at_least`` or more) counts first (source ``header``); else that of the nearest
    directory, its own or one above it, with a licence file (``directory``); else none (null). Of several licence
    files in a directory the highest score counts, then the first by licence. Directories are resolved once each,
    by a join on their ancestors, and files then join their directory. A null path has no directory.
    """
    checked(found, "path", "licence", "score")
    own = F.when(F.col("score") >= at_least, F.col("licence"))
    found = stored(found.drop("effective", "source", "from_dir").withColumn("_own", own).withColumn("_dir", directory(F.col("path"))), "scanned")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    granted = (
        found.where(name.rlike(LICENCE_FILES) & F.col("_own").isNotNull())
        .groupBy(F.col("_dir").alias("ancestor")).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("_own").alias("l"))).alias("g"))
        .select("ancestor", F.col("g.l").alias("granted"))
    )
    parts = F.split("_dir", "/")
    # every directory of the path, itself and the top ("") included
    ancestors = F.transform(F.sequence(F.lit(0), F.when(F.col("_dir") == "", 0).otherwise(F.size(parts))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    places = found.select("_dir").where("_dir is not null").distinct().select("_dir", F.explode(ancestors).alias("ancestor"))
    nearest = (
        places.join(granted, "ancestor").groupBy("_dir").agg(F.max(F.struct(F.length("ancestor").alias("n"), "ancestor", "granted")).alias("b"))
        .select(F.col("_dir").alias("_d"), F.col("b.ancestor").alias("_from"), F.col("b.granted").alias("_granted"))
    )
    joined = found.join(nearest, F.col("_dir") == F.col("_d"), "left")
    kept = [F.col(f"`{c}`") for c in found.columns if c not in ("_own", "_dir")]
    above = F.col("_own").isNull() & F.col("_granted").isNotNull()
    return joined.select(
        *kept, F.coalesce("_own", "_granted").alias("effective"),
        F.when(F.col("_own").isNotNull(), "header").when(above, "directory").alias("source"), F.when(above, F.col("_from")).alias("from_dir"),
    )
