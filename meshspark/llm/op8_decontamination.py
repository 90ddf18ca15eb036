"""Benchmark decontamination by one Aho-Corasick automaton over normalised benchmark items.

Text is normalised to lower-case words joined by one space; the automaton holds every window of 13 words of
every item (a shorter item is one window), each between spaces.  A document is normalised and scanned once;
match ends give word numbers, and word numbers give offsets in the original text.

The automaton goes to the executors only while the benchmark is at most BLOCK_BYTES normalised bytes; a larger
benchmark is cut into blocks of whole items, each scanned in turn, and the hits of a document are merged.

Defined results: null text has no words; a document without words is not contaminated; items without words or
equal items cost nothing twice; an item with a null id is named 'null'; repeated rows stay separate rows;
an empty table gives no rows; further columns are kept by `clean`, ignored by `decontaminate`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WINDOW = 13
#: A document is contaminated if at least 1 in this many of its words is hit.
PART = 20
#: Normalised bytes of benchmark items in one automaton.
BLOCK_BYTES = 4 << 20

#: Bytes of the normalised form: A-Z lowered, ASCII other than digits and letters a space.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_made: dict[str, tuple] = {}


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def _automaton(items: tuple[tuple[str, bytes], ...], window: int):
    """The automaton over (item id, normalised text) rows; made once in each Python worker."""
    import ahocorasick

    key = hashlib.md5(repr((items, window)).encode()).hexdigest()
    if key not in _made:
        found: dict[str, tuple[int, set[int]]] = {}
        for i, (_, words) in enumerate(items):
            w = words.split(b" ")
            for j in range(max(1, len(w) - window + 1)):
                part = w[j : j + window]
                found.setdefault((b" " + b" ".join(part) + b" ").decode("latin-1"), (len(part), set()))[1].add(i)
        a = ahocorasick.Automaton()
        for text, (n, who) in found.items():
            a.add_word(text, (n, tuple(who)))
        a.make_automaton()
        _made.clear()
        _made[key] = (a, [x for x, _ in items])
    return _made[key]


def scan(text: str | None, automaton) -> tuple[int, list[tuple[int, int]], set[int]]:
    """(words, merged hit ranges of word numbers, items) of one text."""
    words = normal_words(text)
    if not words or not len(automaton):
        return len(words), [], set()
    normal = (b" " + b" ".join(words) + b" ").decode("latin-1")
    ranges: list[list[int]] = []
    items: set[int] = set()
    spaces = None
    for end, (n, who) in automaton.iter(normal):
        if spaces is None:
            spaces = np.flatnonzero(np.frombuffer(normal.encode("latin-1"), np.uint8) == 32)
        stop = int(np.searchsorted(spaces, end))
        items.update(who)
        start = stop - n
        while ranges and ranges[-1][1] >= start:
            start = min(start, ranges.pop()[0])
        ranges.append([start, stop])
    return len(words), [(a, b) for a, b in ranges], items


def offsets(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point spans in the original text of ranges of word numbers."""
    if not ranges:
        return []
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.frombuffer(bytes(raw).translate(_NORMAL), np.uint8) != 32
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return [(int(points[starts[a]]), int(points[ends[b - 1]])) for a, b in ranges]


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
HITS = "`__n_words` bigint, `__n_hit` bigint, `__items` array<string>, `__ranges` array<struct<start:bigint,end:bigint>>, `__spans` array<struct<start:bigint,end:bigint>>"


def _scanner(items: tuple[tuple[str, bytes], ...], window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, names = _automaton(items, window)
        for batch in batches:
            texts = batch.column(0)
            n, hit, who, ranges, spans = [], [], [], [], []
            for x in texts:
                words, got, found = scan(x.as_py(), automaton)
                n.append(words)
                hit.append(sum(b - a for a, b in got))
                who.append(sorted({names[i] for i in found}))
                ranges.append([{"start": a, "end": b} for a, b in got])
                spans.append([{"start": a, "end": b} for a, b in offsets(x.as_py(), got)] if got else [])
            new = [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(who, pa.list_(pa.string())), pa.array(ranges, _SPAN), pa.array(spans, _SPAN)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *new], [*batch.schema.names[1:], "__n_words", "__n_hit", "__items", "__ranges", "__spans"])

    return run


def _blocks(benchmark: DataFrame, limit: int) -> list[tuple[tuple[str, bytes], ...]]:
    """The benchmark's items with words, normalised, in blocks of at most `limit` bytes (or one item)."""
    blocks: list[list[tuple[str, bytes]]] = [[]]
    size = 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), "text").distinct()
    for name, text in rows.toLocalIterator():
        if words := normal_words(text):
            one = b" ".join(words)
            if size and size + len(one) > limit:
                blocks.append([])
                size = 0
            size += len(one)
            blocks[-1].append((name, one))
    return [tuple(sorted(b)) for b in blocks]


def scanned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with __n_words, __n_hit, __items, __ranges (of words) and __spans (of code points)."""
    keep = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    blocks = _blocks(benchmark, limit)
    renamed = docs.select(F.col("text").alias("__text"), *[F.col(f"`{c}`") for c in docs.columns])
    parts = [renamed.mapInArrow(_scanner(b, window), f"{keep}, {HITS}") for b in blocks]
    if len(parts) == 1:
        return parts[0]
    # Several automata: the rows' hits are merged by a key that all passes over the table share.
    key = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    found = parts[0].withColumn("__key", key)
    for p in parts[1:]:
        found = found.unionByName(p.withColumn("__key", key))
    hits = found.where("__n_hit > 0").groupBy("__key").agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in ("__items", "__ranges", "__spans")])
    rows = parts[0].drop("__n_hit", "__items", "__ranges", "__spans").withColumn("__key", key).join(hits, "__key", "left")
    none = {c: F.coalesce(c, F.expr("array()").cast(t)) for c, t in (("__items", "array<string>"), ("__ranges", "array<struct<start:bigint,end:bigint>>"), ("__spans", "array<struct<start:bigint,end:bigint>>"))}
    rows = rows.withColumns(none)
    covered = F.expr("aggregate(__ranges, named_struct('n', 0L, 'to', 0L), (a, r) -> named_struct('n', a.n + greatest(0L, r.end - greatest(r.start, a.to)), 'to', greatest(a.to, r.end)), a -> a.n)")
    return rows.withColumn("__n_hit", covered).drop("__key")


CONTAMINATED = f"__n_hit > 0 and {PART} * __n_hit >= __n_words"


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items, spans (code points in the original), contaminated of every row."""
    got = scanned(docs.select("doc_id", "text"), benchmark, window, limit)
    return got.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_hit").alias("n_hit"), F.col("__items").alias("items"), F.col("__spans").alias("spans"), F.expr(CONTAMINATED).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their own columns."""
    return scanned(docs, benchmark).where(f"not ({CONTAMINATED})").select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of benchmark in every row of documents."""
    got = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated")
