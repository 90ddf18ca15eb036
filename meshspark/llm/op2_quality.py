"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters, 8 bytes wide and 4 apart, run over the whole text; their outputs are
max-pooled over chunks of 1 KB that overlap by half and cover the text; the mean over chunks goes through a
logistic unit to one probability.  The network is trained by Adam on a sample of labelled rows on the driver
(SAMPLE rows of each label, the smallest by a hash of the id, of at most SAMPLE_BYTES bytes each); scoring is a
single pass over all texts.

Labels are learned only from rows whose crc32(doc_id) mod 4 is not 2; the score uses the text alone.

Defined results: null and empty texts get the score of a text of no bytes; without labelled rows the score is 1,
with one label only it is that label's smoothed share; of several labels of one id the smallest counts; repeated
rows get equal scores; an empty table gives no rows; further columns are kept by `keep`, ignored by `score`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import staged, table

#: Bound of the training sample: rows of each label, and bytes of a row.
SAMPLE, SAMPLE_BYTES = 2000, 32768
EMBED, FILTERS, STEP, BLOCK = 8, 48, 4, 128
EPOCHS, BATCH, RATE = 12, 32, 4e-3
#: Score from which a document counts as good.
GOOD = 0.7
#: Bytes of text that are scored at once; a longer text is taken piece by piece.
PIECE = 1 << 18

Model = dict[str, np.ndarray]


def initial(rng: np.random.Generator) -> Model:
    f = np.float32
    return {
        "embed": rng.normal(0, 0.5, (256, EMBED)).astype(f), "first": rng.normal(0, 0.15, (STEP * EMBED, FILTERS)).astype(f), "second": rng.normal(0, 0.15, (STEP * EMBED, FILTERS)).astype(f),
        "bias": np.zeros(FILTERS, f), "out": rng.normal(0, 0.1, FILTERS).astype(f), "shift": np.zeros(1, f),
    }


def framed(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes in rows of STEP, first row of each text): each text is padded and followed by a row of zeros."""
    length = np.diff(off)
    rows = np.maximum(1, -(-length // STEP)) + 1
    first = np.concatenate([[0], np.cumsum(rows)])
    out = np.zeros(first[-1] * STEP, np.uint8)
    out[np.repeat(first[:-1] * STEP - off[:-1], length) + np.arange(off[0], off[-1])] = data
    return out.reshape(-1, STEP), first


def responses(m: Model, x: np.ndarray, name: str) -> np.ndarray:
    """Half of a filter's width on rows of bytes, summed in one order from tables of all bytes: the rounding of a
    matrix product depends on a row's place in it, and equal texts must have equal scores."""
    tables = [m["embed"] @ w for w in m[name].reshape(STEP, EMBED, FILTERS)]
    out = tables[0][x[:, 0]]
    for i in range(1, STEP):
        out += tables[i][x[:, i]]
    return out


def forward(m: Model, data: np.ndarray, off: np.ndarray, keep: bool = False):
    """Logits of texts; with keep, also what the backward pass needs."""
    x, first = framed(data, off)
    e = m["embed"][x].reshape(len(x), -1) if keep else None
    act, after = (e @ m["first"], e @ m["second"]) if keep else (responses(m, x, "first"), responses(m, x, "second"))
    act[:-1] += after[1:]
    act += m["bias"]
    np.maximum(act, 0, out=act)
    frames = np.diff(first) - 1  # the row of zeros starts no frame
    blocks = -(-frames // BLOCK)
    block0 = np.concatenate([[0], np.cumsum(blocks)])
    starts = np.repeat(first[:-1] - block0[:-1] * BLOCK, blocks) + np.arange(block0[-1]) * BLOCK
    act[first[1:] - 1] = 0
    top = np.maximum.reduceat(act, starts, axis=0)
    # A chunk is two neighbouring blocks of one text; a text of one block is one chunk.
    last = np.zeros(len(starts), bool)
    last[block0[1:] - 1] = True
    heads = np.flatnonzero(~last | np.repeat(blocks == 1, blocks))
    mate = np.where(last[heads], heads, heads + 1)
    chunk = np.maximum(top[heads], top[mate])
    chunks = np.maximum(blocks - 1, 1)
    chunk0 = np.concatenate([[0], np.cumsum(chunks)])
    mean = np.add.reduceat(chunk, chunk0[:-1], axis=0) / chunks[:, None]
    logit = mean @ m["out"] + m["shift"][0] if keep else (mean * m["out"]).sum(1) + m["shift"][0]
    return (logit, (x, e, act, starts, first, top, heads, mate, chunk, chunks, mean)) if keep else logit


def gradient(m: Model, data: np.ndarray, off: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, Model]:
    logit, (x, e, act, starts, first, top, heads, mate, chunk, chunks, mean) = forward(m, data, off, True)
    p = 1 / (1 + np.exp(-logit))
    loss = float((-(y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7)) * weight).mean())
    d = ((p - y) * weight / len(y)).astype(np.float32)
    g: Model = {"out": mean.T @ d, "shift": np.array([d.sum()], np.float32)}
    dchunk = np.repeat(d / chunks, chunks)[:, None] * m["out"]
    win = np.where(top[heads] >= top[mate], heads[:, None], mate[:, None])  # block that holds the maximum
    # The frame that holds it: the first frame of the block with the block's maximum.
    ends = np.append(starts[1:], len(act))
    where = np.empty(top.shape, np.int64)
    for b in range(len(starts)):
        where[b] = starts[b] + act[starts[b] : ends[b]].argmax(0)
    frame = np.take_along_axis(where, win, 0)
    dchunk = np.where(chunk > 0, dchunk, 0)
    f = np.broadcast_to(np.arange(FILTERS), frame.shape)
    g["bias"] = dchunk.sum(0)
    nxt = np.minimum(frame + 1, len(e) - 1)
    g["first"] = np.einsum("cf,cfk->kf", dchunk, e[frame])
    g["second"] = np.einsum("cf,cfk->kf", dchunk, e[nxt])
    de = np.zeros_like(m["embed"])
    for rows, w in ((frame, m["first"]), (nxt, m["second"])):
        part = (dchunk[..., None] * w.T[f]).reshape(-1, STEP, EMBED).reshape(-1, EMBED)
        at = x[rows].reshape(-1)
        for k in range(EMBED):
            de[:, k] += np.bincount(at, part[:, k], 256).astype(np.float32)
    g["embed"] = de
    return loss, g


def train(texts: list[bytes], labels: list[int], share: float, seed: int = 1) -> Model:
    """The network for texts with labels; ``share`` of all labelled rows have label 1."""
    rng = np.random.default_rng(seed)
    m = initial(rng)
    y = np.array(labels, np.float32)
    n1 = max(1.0, y.sum())
    n0 = max(1.0, len(y) - n1)
    # Weights between a balanced sample and the true shares.
    prior = (share + 0.5) / 2
    weight = np.where(y == 1, prior * len(y) / n1, (1 - prior) * len(y) / n0).astype(np.float32)
    first = {k: np.zeros_like(v) for k, v in m.items()}
    second = {k: np.zeros_like(v) for k, v in m.items()}
    step, total = 0, EPOCHS * -(-len(texts) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for i in range(0, len(texts), BATCH):
            take = order[i : i + BATCH]
            off = np.concatenate([[0], np.cumsum([len(texts[j]) for j in take])])
            _, g = gradient(m, np.frombuffer(b"".join(texts[j] for j in take), np.uint8), off, y[take], weight[take])
            step += 1
            rate = RATE * min(1, 2 * (1 - step / (total + 1)))
            for k in m:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.99 * second[k] + 0.01 * g[k] ** 2
                m[k] = (m[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return m


def constant(p: float) -> Model:
    m = {k: np.zeros_like(v) for k, v in initial(np.random.default_rng(0)).items()}
    m["shift"][0] = np.log(max(p, 1e-9) / max(1 - p, 1e-9))
    return m


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """The network learned from the rows of ``labels`` (doc_id, quality) that are not held out."""
    known = staged(labels.where(~held_out()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("__label")).where("doc_id is not null and __label in (0, 1)"), "quality-labels")
    counts = {r["__label"]: r["n"] for r in known.groupBy("__label").agg(F.count("*").alias("n")).collect()}
    n1, n = counts.get(1, 0), sum(counts.values())
    if not counts.get(0) or not n1:
        return constant((n1 + 1) / (n + 1 + (n1 < n)))
    picked = [r for y in (0, 1) for r in known.where(F.col("__label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    ids = docs.sparkSession.createDataFrame(picked, known.schema)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where(F.octet_length("text") <= sample_bytes).select("doc_id", "text", "__label").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    if len({r["__label"] for r in rows}) < 2:
        return constant((n1 + 1) / (n + 2))
    return train([r["text"].encode() for r in rows], [r["__label"] for r in rows], n1 / n)


def forward_long(m: Model, data: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """The logit of one long text, the same as by `forward`; filters run over a piece of its blocks at a time."""
    x, _ = framed(data, np.array([0, len(data)]))
    step, tops = max(1, piece // (STEP * BLOCK)) * BLOCK, []
    for i in range(0, len(x) - 1, step):
        rows = x[i : i + step + 1]  # a frame's second half is the next row
        act = responses(m, rows[:-1], "first")
        act += responses(m, rows[1:], "second")
        act += m["bias"]
        np.maximum(act, 0, out=act)
        tops.append(np.maximum.reduceat(act, np.arange(0, len(act), BLOCK), axis=0))
    top = np.concatenate(tops)
    chunk = top if len(top) == 1 else np.maximum(top[:-1], top[1:])
    mean = np.add.reduceat(chunk, [0], axis=0) / np.array([[len(chunk)]])
    return (mean * m["out"]).sum(1) + m["shift"][0]


def scores(m: Model, column: pa.Array) -> np.ndarray:
    """Scores of an Arrow column of texts."""
    out = [np.zeros(0)]
    for _, _, data, off in W.pieces(column, PIECE):
        logit = forward_long(m, data) if len(off) == 2 and len(data) > PIECE else forward(m, data, off)
        out.append(1 / (1 + np.exp(-logit.astype(np.float64))))
    return np.concatenate(out)


def _scorer(m: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(scores(m, batch.column(0)), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], score], [*batch.schema.names[1:], "__score"])
        W.give_back()

    return run


def scored(docs: DataFrame, m: Model) -> DataFrame:
    """``docs`` with __score."""
    keep = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return docs.select(F.col("text").alias("__text"), *columns).mapInArrow(_scorer(m), f"{keep}, `__score` double")


def score(docs: DataFrame, m: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text)."""
    got = scored(docs.select("doc_id", "text"), m)
    return got.select("doc_id", held_out().alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= GOOD).cast("int").alias("predicted"))


def keep(docs: DataFrame, m: Model, least: float = GOOD) -> DataFrame:
    """The rows of ``docs`` that the network doesn't reject, with their own columns."""
    return scored(docs, m).where(F.col("__score") >= least).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every row of documents."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
