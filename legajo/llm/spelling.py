"""Words of a corpus grouped by spelling: one-edit neighbours by a frontier that moves down tries held as tables."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legajo.llm.common import checked, map_arrow, stored

LETTERS = "[A-Za-zÀ-ÿ]"
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Words counted in a task between two batches that leave it.
COUNTED = 200_000


def words_of(doc: object, runs: Iterable[str], every: int) -> Iterator[tuple[str, int]]:
    """The runs of letters of a document, A-Z as a-z, with how often they occur; where ``every`` divides the CRC-32 h of
    ``<doc>:<run>``, the run loses its character h % length. A word comes once for each way in which it is written."""
    seed = crc32(f"{'' if doc is None else doc}:".encode())
    for run, n in Counter(runs).items():
        run = run.lower() if run.isascii() else run.translate(LOWER)
        h = crc32(run.encode(), seed)
        if h % every:
            yield run, n
        else:
            k = h % len(run)
            yield run[:k] + run[k + 1 :], n


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 31, least: int = 0) -> DataFrame:
    """``word, n`` of all texts (see ``words_of``); counted in the tasks before anything is shuffled. Words of fewer than
    ``least`` characters are left out: a run only gets shorter, so runs that are too short are not looked at."""
    checked(docs, id_col, text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(f"{LETTERS}{{{max(least, 1)},}}").findall
        seen: dict[str, int] = {}
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for word, n in words_of(doc, find(text.as_py() or ""), every):
                    if len(word) >= least:
                        seen[word] = seen.get(word, 0) + n
                if len(seen) >= COUNTED:
                    yield batch(seen)
                    seen.clear()
        yield batch(seen)

    def batch(seen: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])

    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    return map_arrow(rows, "word string, n long", work).groupBy("word").agg(F.sum("n").alias("n"))


#: Bits in which an edge holds what may follow its child: one for each slot of a byte.
SLOTS = 256


def _slot(rest: Column) -> Column:
    """One of the bits of an edge that stands for what is left of a word, as a byte."""
    return (F.pmod(F.xxhash64(rest), F.lit(SLOTS)) - SLOTS // 2).cast("byte")


def _may_follow(slot: Column) -> Column:
    """Whether what ``slot`` stands for may follow the child of the edge in this row; surely not if false or null."""
    at = slot.cast("int") + SLOTS // 2
    word = F.get(F.col("ahead"), F.shiftright(at, 6))
    return F.call_function("shiftright", word, at.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1).cast("long")) == 1


def tries(vocabulary: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Edge table and paths of two tries over ``vocabulary`` (``word, n``), of the words and of the words reversed.

    A node is a prefix, named by its hash: the first ``least`` // 2 characters, and every prefix at which words part
    or end. An edge is labelled with the characters to its child, so a stretch without a branch is one edge, however
    long: ``level, node, first, label, size, child`` (level: nodes above), the word that ends at the child (``end, end_n``, else null) and, as the
    bits of ``ahead``, all that may follow it. ``word, way, spelled, depths, nodes``: the path of each word.
    """
    root = least // 2
    ways = F.explode(F.array(F.struct(F.lit(0).alias("way"), F.col("word").alias("spelled")), F.struct(F.lit(1).alias("way"), F.reverse("word").alias("spelled"))))
    both = vocabulary.select("word", "n", ways.alias("w")).select("word", "n", "w.way", "w.spelled")
    each = both.select("word", "n", "way", "spelled", F.explode(F.sequence(F.lit(root), F.char_length("spelled"))).alias("depth"))
    each = each.withColumn("node", F.xxhash64("way", F.substring(F.col("spelled"), F.lit(1), F.col("depth"))))
    next_char = F.substring(F.col("spelled"), F.col("depth") + 1, F.lit(1))
    # a prefix is a node if words part or end there; a word that ends has an empty next character
    parts = each.groupBy("node").agg(F.min(next_char).alias("a"), F.max(next_char).alias("b"), F.min("depth").alias("d"))
    parts = parts.where((F.col("a") != F.col("b")) | (F.col("a") == "") | (F.col("d") == root)).select("node")
    kept = each.select("word", "n", "way", "depth", "node").join(parts, "node")
    path = F.array_sort(F.collect_list(F.struct("depth", "node")))  # as long as the word at most
    paths = kept.groupBy("word", "n", "way").agg(path.alias("path"))
    paths = stored(paths.select(
        "word", "n", "way", F.when(F.col("way") == 0, F.col("word")).otherwise(F.reverse("word")).alias("spelled"),
        F.transform("path", lambda p: p["depth"]).alias("depths"), F.transform("path", lambda p: p["node"]).alias("nodes"),
    ), "trie-paths")
    step = F.explode(F.sequence(F.lit(1), F.size("nodes") - 1)).alias("i")
    steps = paths.where(F.size("nodes") > 1).select("word", "n", "spelled", "depths", "nodes", step).select(
        "word", "n", (F.col("i") - 1).alias("level"), F.get("nodes", F.col("i") - 1).alias("node"), F.get("nodes", F.col("i")).alias("child"),
        F.substring(F.col("spelled"), F.get("depths", F.col("i") - 1) + 1, F.get("depths", F.col("i")) - F.get("depths", F.col("i") - 1)).alias("label"),
        F.substring(F.col("spelled"), F.get("depths", F.col("i")) + 1, F.char_length("spelled")).alias("rest"),
    ).withColumn("slot", _slot(F.col("rest")).cast("int") + SLOTS // 2)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(F.lit(63)))
    ends = F.col("rest") == ""
    edges = steps.groupBy("level", "node", "label", "child").agg(
        F.max(F.when(ends, F.col("word"))).alias("end"), F.max(F.when(ends, F.col("n"))).alias("end_n"),
        F.array(*[F.bit_or(F.when(F.shiftright("slot", 6) == k, bit).otherwise(F.lit(0).cast("long"))) for k in range(SLOTS // 64)]).alias("ahead"),
    )
    return stored(edges.withColumns({"first": F.substring("label", 1, 1), "size": F.char_length("label")}), "trie-edges", "level"), paths


STATE = ["word", "way", "pos", "edits", "node"]


def _taken(size: Column) -> Column:
    return F.substring(F.col("spelled"), F.col("pos") + 1, size)


def _arrived(rows: DataFrame, *moves: tuple[int, int, Column]) -> DataFrame:
    """States after ``rows`` (states with an edge each) made those of ``moves`` that they can: characters taken beside
    those of the label, edits made, and a test, which is the last to be looked at."""
    done = []
    for change, edits, test in moves:
        after = F.col("pos") + F.col("size") + change
        alive = F.coalesce(_may_follow(F.get("slots", after)), F.lit(False)) if edits else after <= F.col("whole")
        done.append(F.when(F.when(alive, test).otherwise(False), F.struct(after.alias("pos"), F.lit(edits).alias("edits"))))
    moved = rows.withColumn("m", F.explode(F.array(*done))).where("m is not null")
    return moved.select("word", "way", F.col("m.pos").alias("pos"), F.col("m.edits").alias("edits"), F.col("child").alias("node"), "end", "end_n", (F.col("m.pos") == F.col("whole")).alias("at_end"))


def _moved(states: DataFrame, edges: DataFrame) -> DataFrame:
    """``states`` one node further down. With an edit left, the word may hold the label as it is, with one character
    replaced, or one fewer or more, on every edge of the node; without, only the edge that begins with the word's next
    character and only as it is. What may follow each place of the word is told once, before it meets the edges."""
    states = states.withColumn("spelled", F.when(F.col("way") == 0, F.col("word")).otherwise(F.reverse("word"))).withColumn("whole", F.char_length("spelled"))
    states = states.withColumn("slots", F.transform(F.sequence(F.lit(0), F.col("whole")), lambda i: _slot(F.substring(F.col("spelled"), i + 1, F.col("whole")))))
    size, one = F.col("size"), F.col("size") == 1

    def near(change: int) -> Column:
        return F.levenshtein(_taken(size + change), F.col("label"), 1) == 1

    same = _taken(size) == F.col("label")
    free = _arrived(
        states.where("edits = 0").join(edges, "node"),
        (0, 0, same), (0, 1, F.when(one, ~same).otherwise(near(0))), (-1, 1, one | near(-1)),
        (1, 1, F.when(one, F.contains(_taken(size + 1), F.col("label"))).otherwise(near(1))),
    )
    last = states.where("edits = 1").withColumn("first", _taken(F.lit(1))).join(edges, ["node", "first"])
    return free.unionAll(_arrived(last, (0, 1, same)))


def near_words(vocabulary: DataFrame, least: int = 7) -> DataFrame:
    """All pairs ``word, near, near_n`` of ``vocabulary`` (``word, n``; distinct words of at least ``least`` characters)
    that differ by one inserted, deleted or replaced character, each in both directions.

    States (word, position, node, edits) move down a trie, a level of nodes each round, by a join with its edges.
    The edit stands in the second half of the word or, in the trie of the reversed words, in the first: so a state
    starts at its word's last node within the half that must match, where few words are left. After the edit a state
    lives while the rest of its word may follow the node. Ends reached with one edit are compared whole (names are
    hashes). A round is a level of the tries: as many as there are nodes on the deepest path, and each edge takes
    part in one.
    """
    edges, paths = tries(vocabulary, least)
    half = F.when(F.col("way") == 0, F.floor(F.char_length("word") / 2)).otherwise(F.ceil(F.char_length("word") / 2))
    start = F.size(F.filter("depths", lambda d: d <= half)) - 1
    starts = paths.where(start >= 0).select("word", "way", F.get("depths", start).alias("pos"), F.lit(0).alias("edits"), F.get("nodes", start).alias("node"), start.alias("level"))
    starts = stored(starts, "frontier", "level")
    deepest = edges.agg(F.max("level").alias("level")).first()["level"]
    found, now = [], None
    for level in range(0 if deepest is None else deepest + 1):
        here = starts.where(F.col("level") == level).select(*STATE)
        moved = _moved(here if now is None else now.unionAll(here), edges.where(F.col("level") == level).drop("level"))
        at_end = (F.col("edits") == 1) & F.col("at_end")
        moved = stored(moved.where(~at_end | F.col("end").isNotNull()).withColumn("found", at_end), "frontier")
        found.append(moved.where("found").select("word", F.col("end").alias("near"), F.col("end_n").alias("near_n")))
        now = moved.where("not found").select(*STATE)
    if not found:
        return vocabulary.select("word", F.col("word").alias("near"), F.col("n").alias("near_n")).where("false")
    pairs = found[0]
    for f in found[1:]:
        pairs = pairs.unionAll(f)
    return pairs.where(F.levenshtein("word", "near", 1) == 1).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``forms`` (``word, form``): where following forms ends. A form has ten times the occurrences
    of its word, so chains are short; each round doubles the steps."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        after = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = stored(now.join(after, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        now = step.select("word", "root")
        if step.where("_moved").isEmpty():
            return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, occurrences: int = 2, every: int = 31, ratio: int = 10) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of each word of ``docs``: of at least ``least`` characters, that occurs
    ``occurrences`` times or more.

    Near words differ by one character (see ``near_words``). The form of a word is its most frequent near word (ties:
    the first in code-point order) if that occurs ``ratio`` times as often or more, else null; the root is where
    following forms ends, the word itself if it has none. A null text has no words, a null id counts as an empty
    one; repeated rows count again; an empty table gives an empty result. Long runs are words like any other.
    """
    words = stored(word_counts(docs, id_col, text_col, every, least).where(F.col("n") >= occurrences), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best")
    near = near_words(words, least).groupBy("word").agg(F.count("*").alias("n_near"), best).join(words, "word")
    is_form = -F.col("best.n") >= ratio * F.col("n")
    near = stored(near.select("word", "n_near", F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n")), "near")
    roots = _roots(near.where(F.col("form").isNotNull()))
    return words.join(near, "word", "left").join(roots, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"),
    )
