"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct word shingles.  Sets are put into bands of sizes.  Within a band, two sets
that are similar enough differ in at most k elements.  The domain of shingle hashes is cut into (k + 1) / 2
partitions, so in one of them they differ in at most one element; that partition is cut into 3 parts, and each
choice of 2 parts gives a signature of the elements in them, so one signature is shared.  A set also emits the
signatures of the bands that hold larger sets it could match.

No pairs are emitted within a group of one signature.  Sets that share several signatures are glued to the
group's smallest member; where a group is still in several pieces, members are compared by histograms of their
hashes (whose distance bounds the sets' difference from below, so no link is lost), block against block, and
only a spanning forest of what remains possible is kept.  The clusters so found are verified exactly on whole
sets and a forest of the links is emitted; components of the links are the result.  A large cluster is first
compared block by block, each block with the same few representatives of its cluster; only members that this
leaves outside the cluster's largest component are then compared with all others.  So a cluster of n near copies
costs about n sets, and no link between different components is passed over.
Documents with equal sets are one class from the start.

Classes are named by 64 bits of a hash of the set; for n classes about n * n / 2**65 pairs are merged wrongly.

Defined results: null texts, empty texts and texts without words have no shingles and are linked with nothing;
a text of fewer words than a shingle is one shingle; repeated rows are one class; a null doc_id takes part and
has component null only if no other id is in its component; further columns are ignored (`unique` keeps them).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, LongType, StructField, StructType

from meshspark.operators.components import components

from . import words as W
from .common import met, staged, table

#: Histogram cells by the least size of a set that has them.
CELLS = ((0, 64), (600, 256), (4000, 1024))
#: Members and shingles of a block, rows and shingles that one Python group holds beside, and shared signatures that
#: glue: so many, and one more for every so many shingles, as long documents share some by chance.
BLOCK, BLOCK_SHINGLES, UNIT, UNIT_SHINGLES, GLUE, GLUE_SHINGLES = 1024, 1 << 21, 4096, 1 << 21, 3, 100
#: Members of a large cluster that are compared with all others first, and shingles of one record batch of sets.
REPRESENTATIVES, BATCH_SHINGLES = 8, 1 << 20
#: Signatures of one record batch.
BATCH_SIGNATURES = 1 << 19
#: Bits of a signature that are exchanged; a chance match only costs a comparison.
SIGNATURE_BITS = W.U((1 << 50) - 1)
#: Ids that are broadcast at most; more are joined by shuffling.
SMALL = 500_000


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text of an Arrow column."""
    for i, j, data, off in W.pieces(column):
        starts, ends, bounds = W.word_spans(data, off)
        h = W.word_hashes(data, starts, ends, lower=True)
        w = W.windows(h, n)
        for d in range(j - i):
            lo, hi = bounds[d], bounds[d + 1]
            if hi - lo >= n:
                yield np.unique(w[lo : hi - n + 1])
            elif hi > lo:
                yield W.windows(h[lo:hi], int(hi - lo)) ^ W.U(hi - lo)
            else:
                yield np.zeros(0, W.U)


def class_id(u: np.ndarray) -> int:
    return int(W.mixed(W.mixed(u).sum(dtype=W.U)[None] + W.U(len(u)), 7)[0].view(np.int64))


@lru_cache(None)
def bands(percent: int) -> tuple[float, tuple[int, ...]]:
    """First sizes of the bands: each spans the sizes that about two to four steps of 1 / similarity reach."""
    steps = max(1, round(np.log(1.45) / np.log(100 / percent)))
    ratio, first = (100 / percent) ** steps, [1]
    while first[-1] < 1 << 40:
        first.append(max(first[-1] + 1, int(first[-1] * ratio) + 1))
    return ratio, tuple(first)


@lru_cache(None)
def _plan(band: int, percent: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(edges of the parts, tags of the signatures) of a band; None where only equal sets match."""
    top = bands(percent)[1][band + 1] - 1
    k = 2 * top * (100 - percent) // (100 + percent)
    if k == 0:
        return None
    n1 = (k + 2) // 2
    edges = np.array([-(-(i << 64) // (3 * n1)) for i in range(1, 3 * n1)], W.U)
    tags = W.mixed(np.arange(3 * n1, dtype=W.U) + W.U(band << 40), 3).reshape(n1, 3)
    return edges, tags


def signatures(u: np.ndarray, percent: int) -> np.ndarray:
    """The PartEnum signatures of one set (sorted hashes)."""
    first = bands(percent)[1]
    own = int(np.searchsorted(first, len(u), "right")) - 1
    last = int(np.searchsorted(first, len(u) * 100 // percent, "right")) - 1
    sums = np.concatenate([np.zeros(1, W.U), np.cumsum(W.mixed(u, 5))])
    out = []
    for band in range(own, last + 1):
        if (plan := _plan(band, percent)) is not None:
            edges, tags = plan
            at = np.concatenate([[0], np.searchsorted(u, edges), [len(u)]])
            part = (sums[at[1:]] - sums[at[:-1]]).reshape(-1, 3)
            both = part + np.roll(part, 1, axis=1)
            out.append(W.mixed(both + tags, 11).ravel())
    return np.concatenate(out) if out else np.zeros(0, W.U)


def histogram(u: np.ndarray) -> bytes:
    """Counts of the hashes by their first bits."""
    cells = max(c for least, c in CELLS if len(u) >= least)
    shift = 64 - (cells.bit_length() - 1)
    return np.minimum(np.bincount((u >> W.U(shift)).astype(np.int64), minlength=cells), 255).astype(np.uint8).tobytes()


def _aligned(vecs: list[bytes]) -> np.ndarray:
    """Histograms as rows of as many cells as the coarsest has."""
    n = min(map(len, vecs))
    return np.stack([np.frombuffer(v, np.uint8).astype(np.int16).reshape(n, -1).sum(1) for v in vecs]).astype(np.int16)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    off = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=off[1:])
    values = np.concatenate(parts) if parts else np.zeros(0, W.U)
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values.view(np.int64)))


def _profiles(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, cid, vec = [], [], []
            for u in shingle_sets(batch.column(1), n):
                count.append(len(u))
                cid.append(class_id(u) if len(u) else None)
                vec.append(histogram(u) if len(u) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(cid, pa.int64()), pa.array(vec, pa.binary())], ["doc_id", "n_shingles", "cid", "vec"])
        W.give_back()

    return run


def _signed(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies within a task emit once
        for batch in batches:
            who, parts, held = [], [], 0
            for own, several, u in zip(batch.column(0), batch.column(2), shingle_sets(batch.column(1), n), strict=True):
                if len(u) and (c := class_id(u)) not in seen:
                    seen.add(c)
                    who.append(c if own.as_py() is None or several.as_py() else own.as_py())
                    parts.append(signatures(u, percent) & SIGNATURE_BITS)
                    held += len(parts[-1])
                    if held >= BATCH_SIGNATURES:
                        yield _signature_rows(who, parts)
                        who, parts, held = [], [], 0
            yield _signature_rows(who, parts)
        W.give_back()

    return run


def _signature_rows(who: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
    # A signature of one set may occur twice by chance; it is shared all the same.
    sigs = _lists(parts)
    state = pa.array(W.local_state(sigs.values.to_numpy()))
    sigs = pa.ListArray.from_arrays(sigs.offsets, pa.StructArray.from_arrays([sigs.values, state], ["sig", "state"]))
    return pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), sigs], ["who", "sigs"])


def _whole(n: int):
    """From (text, cid, key, units): the whole set of the class, once for each unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for u, c, k, units in zip(shingle_sets(batch.column(0), n), *(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if not len(u) or class_id(u) != c:
                    continue
                for unit in units:
                    rows.append((unit, k, c, u))
                    held += len(u)
                    if held >= BATCH_SHINGLES:
                        yield _set_rows(rows)
                        rows, held = [], 0
            yield _set_rows(rows)
        W.give_back()

    return run


def _set_rows(rows: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
    unit, key, cid, sets = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [], [])
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (unit, key, cid)), _lists(sets)], ["unit", "key", "cid", "items"])


def _forest(ids: np.ndarray, label: np.ndarray, rows: Callable[[int, int], np.ndarray], step: int) -> list[tuple[int, int]]:
    """A spanning forest, over pieces of equal label, of the graph whose adjacency rows(i, j) gives for i..j."""
    label, out = label.copy(), []
    for i in range(0, len(ids), step):
        linked = rows(i, min(len(ids), i + step))
        for k in range(len(linked)):
            own = i + k
            while len(other := np.flatnonzero(linked[k] & (label != label[own]))):
                j = other[0]
                out.append((int(ids[own]), int(ids[j])))
                label[label == label[j]] = label[own]
    return out


def _groups(t: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The rows of each value of "key" in a unit, once per cid."""
    t = t.sort_by([("key", "ascending"), ("cid", "ascending")])
    key, cid = t["key"].to_numpy(), t["cid"].to_numpy()
    t = t.filter(pa.array(np.r_[True, (key[1:] != key[:-1]) | (cid[1:] != cid[:-1])])) if len(key) else t
    key = t["key"].to_numpy()
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a > 1:
            yield t.slice(a, b - a), t["cid"].to_numpy()[a:b]


def _result(found: list[tuple[int, int]]) -> pa.Table:
    W.give_back()
    return pa.table({"a": pa.array([min(x) for x in found], pa.int64()), "b": pa.array([max(x) for x in found], pa.int64())})


def _possible(percent: int):
    """Pairs that the histograms don't rule out, as a forest over what is already glued."""

    def run(t: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        for g, ids in _groups(t):
            vec = _aligned(g["vec"].to_pylist())
            size, label = g["n"].to_numpy(), g["cluster"].to_numpy()

            def near(i: int, j: int) -> np.ndarray:
                apart = np.abs(vec[i:j, None, :] - vec[None, :, :]).sum(2, dtype=np.int64)
                return apart * (100 + percent) <= (size[i:j, None] + size[None, :]) * (100 - percent)

            found += _forest(ids, label, near, max(1, 4096 // vec.shape[1]))
        return _result(found)

    return run


def _linked(percent: int):
    """Pairs whose whole sets are similar enough, as a forest."""

    def run(t: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        for g, ids in _groups(t):
            sets = g["items"].combine_chunks()
            size = np.diff(sets.offsets.to_numpy())
            values = sets.values.to_numpy()[sets.offsets[0].as_py() : sets.offsets[-1].as_py()]
            _, where, count = np.unique(values, return_inverse=True, return_counts=True)
            shared = count > 1
            column = np.cumsum(shared) - 1
            keep = shared[where]
            row, col = np.repeat(np.arange(len(ids)), size)[keep], column[where[keep]]
            both = np.zeros((len(ids), len(ids)), np.float32)
            order = np.argsort(col, kind="stable")
            row, col = row[order], col[order]
            for c in range(0, int(shared.sum()), 8192):
                a, b = np.searchsorted(col, [c, c + 8192])
                x = np.zeros((len(ids), 8192), np.float32)
                x[row[a:b], col[a:b] - c] = 1
                both += x @ x.T
            both = np.rint(both).astype(np.int64)

            def near(i: int, j: int) -> np.ndarray:
                return 100 * both[i:j] >= percent * (size[i:j, None] + size[None, :] - both[i:j])

            found += _forest(ids, np.arange(len(ids)), near, len(ids))
        return _result(found)

    return run


def _small(rows: DataFrame) -> DataFrame:
    """``rows``, to be broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= SMALL else rows


def _several(rows: DataFrame, value: str) -> DataFrame:
    """The staged ``rows`` (sig, value) of signatures with different values, with the least of them as lo.

    Groups are found by a partially aggregated group-by, so one that holds a third of all rows is no burden.
    """
    ends = staged(rows.groupBy("sig").agg(F.min(value).alias("lo"), F.max(value).alias("hi")).where("lo < hi").select("sig", "lo"), "near-ends")
    return rows.join(_small(ends), "sig")


def _blocked(rows: DataFrame) -> tuple[DataFrame, Column]:
    """(the staged ``rows`` (key, cid, n, ...) with __blocks, the blocks that their group needs, and __own, the row's;
    the unit of a row of a group of one block, which units hold together)."""
    total = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    groups = rows.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("__blocks"))
    large = staged(groups.where("__blocks > 1"), "near-large")
    rows = rows.join(_small(large), "key", "left").withColumn("__blocks", F.coalesce("__blocks", F.lit(1)))
    rows = rows.withColumn("__own", F.pmod(F.xxhash64("cid", F.lit(17)), F.col("__blocks")).cast("int"))
    return rows, F.pmod(F.xxhash64("key"), F.lit(1 + max(total[0] // UNIT, total[1] // UNIT_SHINGLES)))


def _pairs_of_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` (key, cid, n, ...) with units: one for small groups, one for each pair of blocks with its own in large."""
    rows, alone = _blocked(staged(rows, "near-rows"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("__blocks") - 1), lambda o: F.xxhash64("key", F.least("__own", o), F.greatest("__own", o)))
    return rows.withColumn("units", F.when(F.col("__blocks") == 1, F.array(alone)).otherwise(pairs)).drop("__blocks", "__own", "n")


def _verified(texts: DataFrame, who: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): links that connect the classes of each cluster as far as they are similar enough, from the staged
    ``who`` (cid, key, __id, n)."""

    def links(rows: DataFrame) -> DataFrame:
        wanted = _small(staged(rows.select("cid", "key", "__id", "units"), "near-units"))
        sets = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["__id"])).select("text", "cid", "key", "units").mapInArrow(_whole(n), "unit bigint, key bigint, cid bigint, items array<bigint>")
        return staged(sets.groupBy("unit").applyInArrow(_linked(percent), "a bigint, b bigint"), "near-links")

    rows, alone = _blocked(who)
    large = rows.where("__blocks > 1")
    heads = large.groupBy("key", F.pmod(F.xxhash64("cid", F.lit(3)), F.lit(REPRESENTATIVES))).agg(F.min("cid").alias("cid")).select("cid", F.lit(True).alias("__head"))
    heads = staged(heads, "near-heads")
    every = F.transform(F.sequence(F.lit(0), F.col("__blocks") - 1), lambda o: F.xxhash64("key", o))
    units = F.when(F.col("__blocks") == 1, F.array(alone)).when(F.col("__head"), every).otherwise(F.array(F.xxhash64("key", "__own")))
    first = links(rows.join(_small(heads), "cid", "left").withColumn("units", units))
    if heads.isEmpty():
        return first
    found = components(first).withColumnsRenamed({"node": "cid"})
    named = staged(large.join(found, "cid", "left").select("key", "cid", "__id", F.coalesce("component", "cid").alias("part")), "near-parts")
    sizes = named.groupBy("key", "part").agg(F.count("*").alias("members")).groupBy("key").agg(F.max(F.struct("members", "part")).alias("main"), F.sum("members").alias("members"))
    sizes = sizes.where("members > main.members").select("key", F.col("main.part").alias("main"), F.ceil((F.col("members") - F.col("main.members")) / BLOCK).cast("int").alias("__rest"), F.ceil(F.col("main.members") / BLOCK).cast("int").alias("__mains"))
    sizes = staged(sizes, "near-sizes")
    if sizes.isEmpty():
        return first
    left = named.join(_small(sizes), "key").withColumn("__in", F.col("part") == F.col("main"))
    own = F.pmod(F.xxhash64("cid", F.lit(19)), F.when(F.col("__in"), F.col("__mains")).otherwise(F.col("__rest"))).cast("int")
    left = left.withColumn("__own", own)
    rest = F.sequence(F.lit(0), F.col("__rest") - 1)
    across = F.transform(rest, lambda o: F.xxhash64("key", F.lit(1), o, F.col("__own")))
    own_pairs = F.transform(rest, lambda o: F.xxhash64("key", F.lit(0), F.least("__own", o), F.greatest("__own", o)))
    to_main = F.transform(F.sequence(F.lit(0), F.col("__mains") - 1), lambda o: F.xxhash64("key", F.lit(1), F.col("__own"), o))
    return first.unionByName(links(left.withColumn("units", F.when(F.col("__in"), across).otherwise(F.concat(own_pairs, to_main)))))


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text); see the module's head."""
    return _classed(docs, n, percent).select("doc_id", "n_shingles", "component_id")


def _classed(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, cid (class), component_id, first (the class has the component's smallest doc_id, and the
    smallest name among those) of every row of ``docs``."""
    texts = docs.select("doc_id", "text")
    prof = staged(texts.mapInArrow(_profiles(n), f"doc_id {dict(texts.dtypes)['doc_id']}, n_shingles bigint, cid bigint, vec binary"), "near-docs")
    least = prof.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("low"))
    # Signatures are exchanged under the id of a document, which packs far better than the name of its class; an id of
    # several classes does not tell them apart, so these go under their own names.  An id is left out if no class has
    # it as its smallest.
    ids = prof.join(least, "cid").where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.col("doc_id") == F.col("low")).alias("own"), (F.min("cid") < F.max("cid")).alias("several"))
    ids = staged(ids.where("not own or several"), "near-spare")
    own_id = F.col("doc_id").cast("bigint") if isinstance(texts.schema["doc_id"].dataType, IntegralType) else F.lit(None).cast("bigint")
    first = _flagged(_without(texts, ids.where("not own").select("__id")), ids.where("several").select("__id"))
    rows = first.select(own_id, "text", "__several").mapInArrow(_signed(n, percent), "who bigint, sigs array<struct<sig:bigint,state:tinyint>>").select("who", F.inline("sigs"))
    found = met(rows, "sig", "who", "who").where("lo < hi or state > 0")
    found = staged(found.select("sig", "who"), "near-found")
    names = _flagged(prof.where("cid is not null"), ids.where("several").select("__id"))
    names = names.select(F.when(F.col("__several"), F.col("cid")).otherwise(F.coalesce(own_id, "cid")).alias("who"), "cid").distinct()
    members = staged(found.join(names, "who").select("sig", "cid").distinct(), "near-named")
    members = staged(_several(members, "cid"), "near-members")

    vecs = prof.where("cid is not null").groupBy("cid").agg(F.min("vec").alias("vec"), F.max("n_shingles").alias("n"), F.min("doc_id").alias("doc_id"))
    shared = members.where("cid <> lo").groupBy(F.col("lo").alias("a"), "cid").agg(F.count("*").alias("shared"))
    glued = shared.join(vecs.select("cid", "n"), "cid").where(f"shared >= {GLUE} + n / {GLUE_SHINGLES}").select("a", F.col("cid").alias("b"))
    glued = staged(glued, "near-glued")
    cluster = components(glued)
    named = staged(members.join(cluster.withColumnRenamed("node", "cid"), "cid", "left").select("sig", "cid", F.coalesce("component", "cid").alias("cluster")), "near-clusters")
    mixed_ = _several(named, "cluster")
    open_ = _pairs_of_blocks(mixed_.select(F.col("sig").alias("key"), "cid", "cluster", F.lit(0).alias("n"))).withColumn("unit", F.explode("units")).drop("units")
    more = open_.join(vecs.drop("doc_id"), "cid").groupBy("unit").applyInArrow(_possible(percent), "a bigint, b bigint")
    cluster = components(glued.unionByName(more.distinct()))

    who = cluster.join(vecs.select("cid", "doc_id", "n"), cluster["node"] == vecs["cid"]).select("cid", F.col("component").alias("key"), F.col("doc_id").alias("__id"), "n")
    found = components(_verified(texts, staged(who, "near-who"), n, percent))
    least = least.join(found.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    roots = least.groupBy("component").agg(F.min("low").alias("component_id"), F.min(F.struct(F.col("low").isNull(), "low", "cid"))["cid"].alias("keeper"))
    classes = least.join(roots, "component").select("cid", "component_id", (F.col("cid") == F.col("keeper")).alias("first"))
    return prof.select("doc_id", "n_shingles", "cid").join(classes, "cid", "left").select("doc_id", "n_shingles", "cid", F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "first")


def _flagged(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` with __several: whether its doc_id is one of ``ids`` (__id)."""
    k = ids.count()
    if not k:
        return rows.withColumn("__several", F.lit(False))
    ids = ids.withColumn("__several", F.lit(True))
    both = rows.join(F.broadcast(ids) if k <= SMALL else ids, rows["doc_id"] == ids["__id"], "left").drop("__id")
    return both.withColumn("__several", F.coalesce("__several", F.lit(False)))


def unique(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are the first of their component, with their own columns.

    The first is the class with the smallest doc_id.  Of several rows of one id and class one stays (the least text),
    rows of one id with other texts are judged by their own components, and rows without an id all stay.
    """
    found = _classed(docs, n, percent).where("doc_id is not null")
    found = staged(found.select("doc_id", "cid", F.expr("cid is null or first and doc_id = component_id").alias("stays")), "near-found")
    ids = staged(found.groupBy("doc_id").agg(F.max("stays").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1"), "near-stays")
    rest = _without(docs, ids.where("not stays").select(F.col("doc_id").alias("__id")))
    twice = ids.where("stays").select("doc_id")
    k = twice.count()
    if not k:
        return rest
    several = rest.join(F.broadcast(twice) if k <= SMALL else twice, "doc_id", "left_semi").select(docs.columns)
    classed = several.mapInArrow(_with_class(n, docs.columns.index("text")), StructType([*several.schema.fields, StructField("__cid", LongType())]))
    first = found.where("stays").join(twice, "doc_id", "left_semi").select(F.col("doc_id").alias("__id"), F.col("cid").alias("__own")).distinct()
    classed = classed.join(first, (F.col("doc_id") == F.col("__id")) & F.col("__cid").eqNullSafe(F.col("__own")), "left_semi")
    once = classed.groupBy("doc_id", "__cid").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct("text")).alias("__row")).select("__row.*")
    return _without(rest, twice.withColumnRenamed("doc_id", "__id")).unionByName(once)


def _with_class(n: int, text: int):
    """Rows with the class of their text beside their own columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid = pa.array([class_id(u) if len(u) else None for u in shingle_sets(batch.column(text), n)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, cid], [*batch.schema.names, "__cid"])

    return run


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows of ``ids`` (__id)."""
    ids = staged(ids, "near-ids")
    return docs.join(_small(ids), docs["doc_id"] == ids["__id"], "left_anti")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near equal documents over every row of documents."""
    return jaccard_components(table(spark, sf_dir, "documents"), 3, 90)
