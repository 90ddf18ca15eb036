"""Substring dedup by landmarks at content-defined places of word sequences, in place of recompression.

Words are the letters.  Level 1 names runs of two equal letters, pairs of a left and a right letter (a bit of a
letter's hash says which it is) and single letters; whether a run or pair is formed depends only on the letters next
to it.  Level 2 names, at every level-1 boundary, the sequence of level-1 symbols of the 6 or 7 words after it.  A
name is a hash of the names below it and depends on nothing else, so equal substrings get equal interior symbols in
every task and naming needs no exchange.  Of the level-2 symbols that every window of 20 words surely contains whole,
the least is the window's landmark; equal windows have equal landmarks at equal places.

Spark rounds: (1) landmarks are exchanged by name, which leaves those that occur more than once; (2) the windows
with such a landmark are exchanged by a hash of their 20 words, which verifies the repeat and finds each window
that also starts earlier; (3) the words of those windows are removed.  Documents of equal word sequences are one
class from the start: only the first takes part, the others are removed whole.  Texts are read again in rounds 2
and 3, only those of documents concerned.  In both exchanges a name that repeats within a batch is known to be shared
and sends one row, so that no task gets all rows of a passage that is everywhere.

Names, classes and windows are told apart by 64 bits of a hash.

Defined results: null and empty texts have no words; a document of fewer words than a window keeps all; a null
doc_id comes after all others, and among equal doc_ids a hash of the text decides; repeated rows (same id, same
text) are the same document and get the same result; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import meeting, staged, table

WINDOW = 20
#: Words that a level-2 symbol covers at least; level-1 symbols have at most 2.
COVER = 6
#: Words at either end of a window within which level-1 boundaries may depend on what is outside.
EDGE = 2
#: Ids that are broadcast at most; more are joined by shuffling.
SMALL = 500_000
NEVER = W.U(0xFFFFFFFFFFFFFFFF)


def level1(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether each word starts a level-1 symbol."""
    n = len(h)
    joint = np.ones(n + 1, bool)  # joint[i]: word i begins a text, or there is none
    joint[1:-1] = False
    joint[bounds] = True
    same = np.zeros(n + 1, bool)  # same[i]: word i equals the one before it in its text
    same[1:n] = (h[1:] == h[:-1]) & ~joint[1:n]
    left = (W.mixed(h, 21) & W.U(1)) == 1
    in_run = same[:n] | same[1:]
    pair = np.zeros(n, bool)  # pair[i]: words i - 1 and i are one symbol
    if n > 1:
        pair[1:] = left[:-1] & ~left[1:] & ~in_run[:-1] & ~in_run[1:] & ~joint[1:n]
        before = np.r_[False, same[: n - 1]]
        pair |= same[:n] & ~before & ~same[1:]
    return ~pair


def level2(h: np.ndarray, bounds: np.ndarray, cover: int = COVER) -> np.ndarray:
    """The level-2 symbol that starts at each word; NEVER where none does."""
    n = len(h)
    out = np.full(n, NEVER)
    if n < cover:
        return out
    at = np.flatnonzero(level1(h, bounds))
    after = np.r_[at[1:], n]
    # A level-1 name: the word's, or that of both words of a run or pair.
    name = W.mixed(h[at], 22)
    two = after - at > 1
    name[two] = W.mixed(name[two] * W.U(W.BASE) + h[at[two] + 1], 24)
    # Names of level-1 symbols are folded until they cover enough words; a text's end is a boundary too.
    fold, done = np.zeros(len(at), W.U), np.zeros(len(at), np.int64)
    for j in range(cover):
        k = np.flatnonzero(done[: len(at) - j] < cover)
        fold[k] = W.mixed(fold[k] * W.U(W.BASE) + name[k + j])
        done[k] = after[k + j] - at[k]
    stop = np.repeat(bounds[1:], np.diff(bounds))[at]
    fits = (done >= cover) & (at + done <= stop)
    out[at[fits]] = np.minimum(W.mixed(fold[fits], 23), NEVER - W.U(1))
    return out


def landmarks(symbols: np.ndarray, bounds: np.ndarray, window: int, cover: int = COVER) -> tuple[np.ndarray, np.ndarray]:
    """(landmark of the window that starts at each word, or 0 where none does; whether a word is one's place)."""
    n, width = len(symbols), window - 2 * EDGE - cover
    low = np.zeros(n, W.U)
    chosen = np.zeros(n, bool)
    if n < window:
        return low, chosen
    starts = np.arange(n - window + 1)
    whole = starts + window <= np.repeat(bounds[1:], np.diff(bounds))[: len(starts)]
    least = W.sliding(np.minimum, symbols[EDGE:], width)[: len(starts)]
    low[: len(starts)][whole] = least[whole]
    padded = np.concatenate([np.zeros(width - 1, W.U), low])
    top = W.sliding(np.maximum, padded, width)  # top[i]: most of low[i - width + 1 .. i]
    chosen[EDGE:] = (top[: n - EDGE] == symbols[EDGE:]) & (symbols[EDGE:] != NEVER)
    return low, chosen


def sequence(text: bytes) -> tuple[int, bytes, int]:
    """(words, kept text, class) of a text with nothing removed."""
    words = text.split()
    kept = b" ".join(words)
    return len(words), kept, int.from_bytes(hashlib.sha256(kept).digest()[:8], "little", signed=True)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, cls, sha = [], [], []
        for x in batch.column(1).cast(pa.large_binary()):
            words, kept, c = sequence(x.as_py() or b"")
            n.append(words)
            cls.append(c)
            sha.append(hashlib.sha256(kept).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(sha)], ["doc_id", "n_words", "cls", "sha"])


def _parsed(column: pa.Array, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bounds, word hashes, level-2 symbols, landmarks, places) of runs of texts."""
    for i, _, data, off in W.pieces(column):
        starts, ends, bounds = W.word_spans(data, off)
        h = W.word_hashes(data, starts, ends)
        symbols = level2(h, bounds)
        yield i, bounds, h, symbols, *landmarks(symbols, bounds, window)


def _list(values: np.ndarray, lengths: list[int], kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(values, kind))


def _marks(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies within a task emit once
        for batch in batches:
            texts = batch.column(0).cast(pa.large_binary())
            classes, keys, places, lengths = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], []
            for i, bounds, _, symbols, _, chosen in _parsed(batch.column(0), window):
                for d in range(len(bounds) - 1):
                    lo, hi = bounds[d], bounds[d + 1]
                    if hi - lo < window or (c := sequence(texts[i + d].as_py())[2]) in seen:
                        continue
                    seen.add(c)
                    at = np.flatnonzero(chosen[lo:hi])
                    classes.append(c)
                    lengths.append(len(at))
                    keys.append(symbols[lo + at].view(np.int64))
                    places.append(at.astype(np.int32))
            key = np.concatenate(keys)
            marks = pa.StructArray.from_arrays([pa.array(key), pa.array(np.concatenate(places)), pa.array(W.local_state(key))], ["key", "pos", "state"])
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), marks)], ["cls", "marks"])

    return run


def _windows(window: int):
    """From (text, cls, pos: places of shared landmarks): hashes and starts of the windows that have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # repeated rows within a task emit once
        for batch in batches:
            # In the order in which a window counts as earlier; its places follow.
            batch = batch.take(pc.sort_indices(batch, sort_keys=[(c, "ascending") for c in ("doc_id", "cls")], null_placement="at_end"))
            texts, cls, pos = batch.column(0).cast(pa.large_binary()), batch.column(1).to_numpy(), batch.column(2)
            rows, hashes, starts, lengths = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], []
            for i, bounds, h, symbols, low, _ in _parsed(batch.column(0), window):
                shared = np.full(len(symbols), NEVER)
                own = []
                for d in range(len(bounds) - 1):
                    own.append((c := int(cls[i + d])) not in seen and sequence(texts[i + d].as_py() or b"")[2] == c)
                    if own[-1]:
                        seen.add(c)
                for d in np.flatnonzero(own):
                    at = bounds[d] + np.asarray(pos[int(i + d)].as_py(), np.int64)
                    shared[at] = symbols[at]
                least, _ = landmarks(shared, bounds, window)
                hit = (least == low) & (low != 0) & (low != NEVER)
                w = W.windows(h, window)
                for d in np.flatnonzero(own):
                    at = np.flatnonzero(hit[bounds[d] : bounds[d + 1]])
                    rows.append(int(i + d))
                    lengths.append(len(at))
                    hashes.append(w[bounds[d] + at].view(np.int64))
                    starts.append(at.astype(np.int32))
            key = np.concatenate(hashes)
            found = pa.StructArray.from_arrays([pa.array(key), pa.array(np.concatenate(starts)), pa.array(W.local_state(key))], ["hash", "pos", "state"])
            found = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), found)
            yield pa.RecordBatch.from_arrays([batch.column(3).take(pa.array(rows, pa.int64())), pa.array(cls[rows], pa.int64()), found], ["doc_id", "cls", "found"])

    return run


def _cut(window: int):
    """From (text, cls, pos: starts of repeated windows): words removed and the text that is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, removed, texts = [], [], []
            for text, c, pos in zip(batch.column(0).cast(pa.large_binary()), batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or b"").split()
                if sequence(text.as_py() or b"")[2] != c.as_py():
                    continue
                at = np.asarray(pos.as_py(), np.int64)
                edge = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + window, minlength=len(words) + 1)
                gone = np.cumsum(edge)[: len(words)] > 0
                classes.append(c.as_py())
                removed.append(int(gone.sum()))
                texts.append(b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], ["cls", "n_removed", "kept"])

    return run


def _with_texts(docs: DataFrame, places: DataFrame, classes: DataFrame) -> DataFrame:
    """(text, cls, pos, doc_id) of the first document of each class in ``places`` (cls, pos)."""
    who = staged(places.join(classes, "cls").select("cls", "pos", F.col("low").alias("__id")), "repeat-who")
    ids = staged(who.select("__id").distinct(), "repeat-ids")
    if ids.count() <= SMALL:
        docs = docs.join(F.broadcast(ids), docs["doc_id"].eqNullSafe(ids["__id"]), "left_semi")
    return docs.join(who, docs["doc_id"].eqNullSafe(who["__id"])).select("text", "cls", "pos", "doc_id")


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept, kept_sha256 of every row of ``docs`` (doc_id, text).

    kept is the text that is left where words were removed, and null where all words stay.
    """
    texts = docs.select("doc_id", "text")
    id_type = dict(texts.dtypes)["doc_id"]
    prof = staged(texts.mapInArrow(_profiles, f"doc_id {id_type}, n_words bigint, cls bigint, sha string"), "repeat-docs")
    classes = prof.groupBy("cls").agg(F.min("doc_id").alias("low"))

    marks = texts.select("text").mapInArrow(_marks(window), "cls bigint, marks array<struct<key:bigint,pos:int,state:tinyint>>").select("cls", F.inline("marks"))
    one, occurrence = meeting("key", "cls", "pos"), F.xxhash64("cls", "pos")
    shared = marks.withColumn("lo", F.min(occurrence).over(one)).withColumn("hi", F.max(occurrence).over(one)).where("lo < hi or state > 0")
    shared = shared.groupBy("cls").agg(F.collect_set("pos").alias("pos"))

    found = _with_texts(texts, shared, classes).mapInArrow(_windows(window), f"doc_id {id_type}, cls bigint, found array<struct<hash:bigint,pos:int,state:tinyint>>")
    found = found.select("doc_id", "cls", F.inline("found"))
    order = meeting("hash", "cls", "pos").orderBy(F.col("doc_id").isNull(), "doc_id", "cls", "pos")
    first = F.first(F.struct("cls", "pos")).over(order)
    again = found.withColumn("first", first).where("state = 2 or first.cls <> cls or first.pos <> pos")
    again = again.groupBy("cls").agg(F.collect_set("pos").alias("pos"))

    cut = _with_texts(texts, again, classes).mapInArrow(_cut(window), "cls bigint, n_removed bigint, kept string")
    cut = cut.groupBy("cls").agg(F.max("n_removed").alias("cut"), F.max("kept").alias("kept"))
    out = prof.join(classes, "cls").join(cut, "cls", "left")
    copy = (F.col("n_words") >= window) & (F.coalesce(F.col("doc_id") > F.col("low"), F.col("doc_id").isNull() & F.col("low").isNotNull()))
    return out.select("doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0))).alias("n_removed"), F.when(copy, "").otherwise(F.col("kept")).alias("kept"), F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).when(F.col("kept").isNotNull(), F.sha2("kept", 256)).otherwise(F.col("sha")).alias("kept_sha256"))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that repeat an earlier window of 20, over every row of documents."""
    return repeats(table(spark, sf_dir, "documents")).drop("kept")
