"""Operators against plain versions of what they compute, and the pipeline stage by stage."""

import collections
import itertools
import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meshspark.llm import op1_mixing, op2_quality, op3_jaccard, op4_substring, op7_pii, op9_html, op10_chat

from test_operators import WORDS, cut, prose

DATA = "/root/testdata/sf0.001"


def components(rows, n, percent):
    """(set size, least id of the component) of every document, by all pairs."""
    sets = {}
    for d, t in rows:
        w = WORDS.findall((t or "").lower())
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {d: (len(sets[d]), top(d)) for d in sets}


def test_schedule_is_the_golden_ratio_order(spark):
    rows = [(i, "w " * (1000 + i % 37), "abc"[i % 3] if i % 10 else None) for i in range(120)]
    m = op1_mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    got = dict(m.schedule.select("slot", "source").distinct().collect())
    # By brute force: sources' slots in order, the i-th slot at the rank of its point.
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    order = ["a", "b", "c", None]
    weight = dict(zip(order, (5, 2, 1, 5)))
    full, level = set(), 0.0
    while True:
        level = (sum(size.values()) - sum(3 * size[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and level * weight[s] > 3 * size[s]}
        if not more:
            break
        full |= more
    target = {s: 3 * size[s] if s in full else level * weight[s] for s in order}
    blocks = {s: -(-size[s] // op1_mixing.BLOCK) for s in order}
    need = {s: int(target[s] + 1e-6) // size[s] * blocks[s] + -(-(int(target[s] + 1e-6) % size[s]) // op1_mixing.BLOCK) for s in order}
    places = [s for s in order for _ in range(need[s])]
    points = sorted((i * op1_mixing.PHI31 % (1 << 31), i) for i in range(len(places)))
    assert got == {i: places[rank] for rank, (_, i) in enumerate(points)}
    docs = m.documents.toPandas()
    traced = m.schedule.groupBy("doc_id").agg(F.min("slot").alias("first"), F.count("*").alias("n")).toPandas().set_index("doc_id")
    assert all(math.isnan(r.first_slot) if r.n_slots == 0 else (r.first_slot, r.n_slots) == tuple(traced.loc[r.doc_id]) for r in docs.itertuples())
    taken = docs.assign(source=docs["source"].fillna("-")).groupby("source").agg(taken=("taken", "sum"), target=("target", "max"))
    assert all(t == int(x + 1e-6) for t, x in zip(taken["taken"], taken["target"]))


def plain_score(m, text):
    """The network by loops over frames, chunks and filters."""
    data = text + b"\0" * (-len(text) % op2_quality.STEP if text else op2_quality.STEP)
    rows = [data[i : i + op2_quality.STEP] for i in range(0, len(data), op2_quality.STEP)] + [b"\0" * op2_quality.STEP]
    act = []
    for i in range(len(rows) - 1):
        x = np.concatenate([m["embed"][b] for b in rows[i]]) @ m["first"] + np.concatenate([m["embed"][b] for b in rows[i + 1]]) @ m["second"]
        act.append(np.maximum(x + m["bias"], 0))
    tops = [np.max(act[i : i + op2_quality.BLOCK], axis=0) for i in range(0, len(act), op2_quality.BLOCK)]
    chunks = [np.maximum(a, b) for a, b in zip(tops, tops[1:])] or tops
    return 1 / (1 + math.exp(-float(np.mean(chunks, axis=0) @ m["out"] + m["shift"][0])))


def test_network_equals_plain_loops():
    rng = np.random.default_rng(5)
    m = op2_quality.initial(rng)
    texts = ["", "a", "abcd", "Grüße 😀 " * 9, "x" * 511, "x" * 512, "x" * 513, "".join(chr(97 + i) for i in rng.integers(0, 26, 3000))]
    got = op2_quality.scores(m, pa.array(texts))
    assert np.allclose(got, [plain_score(m, t.encode()) for t in texts], atol=1e-5)


def test_long_texts_score_the_same_in_pieces():
    rng = np.random.default_rng(6)
    m = op2_quality.initial(rng)
    for n in (1, 4, 2047, 2048, 2049, 70_001):
        data = rng.integers(32, 127, n).astype(np.uint8)
        assert op2_quality.forward_long(m, data, 2048)[0] == op2_quality.forward(m, data, np.array([0, n]))[0]


def test_jaccard_links_a_drifting_chain_in_large_clusters(spark, monkeypatch):
    monkeypatch.setattr(op3_jaccard, "BLOCK", 8)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for d in range(200):  # each differs from the last in one word, from the first in up to all
        rows.append((d, " ".join(words)))
        words[(d * 7) % 400] = f"n{d}"
    random.seed(1)
    base = [f"b{i}" for i in range(300)]
    for d in range(200, 260):  # copies with one word of their own, and a few that are too far
        w = list(base)
        for _ in range(1 if d % 10 else 60):
            w[random.randrange(300)] = f"c{d}"
        rows.append((d, " ".join(w)))
    got = op3_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 90)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == components(rows, 3, 90)


def test_jaccard_takes_ids_of_any_type(spark):
    t = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([("b", t), ("a", t + " more"), ("c", "else")], "doc_id string, text string")
    assert sorted(tuple(r) for r in op3_jaccard.jaccard_components(docs).collect()) == [("a", 99, "a"), ("b", 98, "a"), ("c", 1, "c")]


def test_substring_of_a_passage_that_is_everywhere(spark):
    random.seed(4)
    common = " ".join(f"p{i}" for i in range(45))
    rows = [(d, f"{t} {common} {' '.join(random.choice('xyz') for _ in range(60))}") for d, t in prose(3, 60)] + [(90, "z " * 200), (91, "z " * 55)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = op4_substring.repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()} == cut(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def luhn(x):
    d = [int(c) for c in re.sub("[^0-9]", "", x)]
    return 12 <= len(d) <= 19 and sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(reversed(d))) % 10 == 0


def test_addresses_and_cards_against_brute_force(spark):
    ip, card = r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"[0-9](?:[\x20-]?[0-9])+"
    random.seed(7)
    parts = ["a ", "10.0.0.1", "256.1.1.1", "1.2.3.4.5.6.7.8", ".", "4111 1111 1111 1111", "4111-1111-1111-1112", "378282246310005", " ", "-", "7", "00012", "é", "000000000000"]
    rows = [(i, "".join(random.choice(parts) for _ in range(12))) for i in range(300)]
    got = {r["doc_id"]: r["base"] for r in op7_pii.spotted(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, t in rows:
        of = lambda kind: [(s["start"], s["end"]) for s in got[i] if s["kind"] == kind]  # noqa: B023, E731
        assert of("ip") == [m.span() for m in re.finditer(ip, t) if all(int(p) <= 255 for p in m[0].split("."))]
        assert of("card") == [m.span() for m in re.finditer(card, t) if luhn(m[0])]


def test_added_spans_touch_no_others(spark):
    texts = ["password = k7f9a0b1c2d3e4f5a6b7 and 10.0.0.1", "ssn: 123-45-6789, iban DE89 3704 0044 0532 0130 00", "card 4111111111111112 tel. (234) 555-1234", "plain words only"] * 30
    rows = op7_pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    for r in rows:
        spans = sorted((s["start"], s["end"]) for s in r["spans"])
        added = [(s["start"], s["end"]) for s in r["spans"] if s not in r["base"]]
        assert all(s in r["spans"] for s in r["base"])
        assert all(b[0] >= a[1] for a in added for b in spans if b > a)
    assert any(s["kind"] == "secret" for s in rows[0]["spans"]) and rows[3]["spans"] == []


def test_reliable_labelers_are_told_from_noise():
    # Labelers 0 and 1 agree on true spans, 3 votes at random: its rate must be near a half in both classes.
    counts = {("secret", 0b0011): 400, ("secret", 0b1011): 400, ("secret", 0): 500, ("secret", 0b1000): 500}
    post = op7_pii.em(counts)
    assert post["secret", 0b0011] > 0.9 and post["secret", 0b1000] < 0.2
    model = op7_pii.train({(k, v, t): n for (k, v), n in counts.items() for t in (0, 1)})
    assert len(model.traits["secret"]) == 1 + op7_pii.TRAITS and max(map(abs, model.traits["secret"])) < 0.5


def plain_second_pass(found, label, marked, inside):
    out = []
    for i, x in enumerate(label):
        if x is None:
            before = [j for j in range(i) if label[j] is not None][-1:]
            after = [j for j in range(i + 1, len(label)) if label[j] is not None][:1]
            near = [(abs(j[0] - i), found[j[0]], label[j[0]]) if j else None for j in (before, after)]
            x = op9_html._inherited(found[i], *near, marked) if any(near) else (found[i].main if inside else found[i].links == 0 and found[i].tag not in ("", "li"))
        out.append(x)
    return out


def test_second_pass_against_brute_force():
    random.seed(11)
    texts = ["Short.", "word " * 20, "It was in the spring of the year that they came to the house by the river. " * 3, "xq zzt kkr vvp " * 20, "<a href=x>link link link link link link link</a>"]
    for _ in range(200):
        body = [f"<{t}>{random.choice(texts)}</{t}>" for t in random.choices(["p", "h2", "li", "div"], k=random.randrange(1, 14))]
        k = random.randrange(len(body) + 1)
        page = "".join(body[:k]) + ("<article>" if random.random() < 0.5 else "<div>") + "".join(body[k:])
        found = op9_html.blocks(page)
        stops = op9_html._stops(found)
        inside = [b for b in found if b.main and b.links <= op9_html.LINKS]
        marked = sum(len(b.text) for b in inside) >= op9_html.LONG or any(op9_html._decided(b, s, False) for b, s in zip(found, stops) if b.main)
        label = [op9_html._decided(b, s, marked) for b, s in zip(found, stops)]
        assert op9_html.extract(page) == "\n\n".join(b.text for b, x in zip(found, plain_second_pass(found, label, marked, inside)) if x)


@pytest.mark.parametrize("piece", ["<a x ", "<div></section>", "<p '", "<!", "<p '\">", "<nav><article>", "< ", "<section><article><div>"])
def test_hostile_pages_take_time_in_proportion(piece):
    began = time.time()
    op9_html.extract(piece * (1_000_000 // len(piece)))
    assert time.time() - began < 20


def test_conversations_without_an_id_and_long_ones(spark):
    turns = [(1, i, "user", f"t{i}") for i in range(3000)] + [(2, i, "user", f"t{i}") for i in range(2999)] + [(3, 0, "user", "x")]
    turns += [(None, 0, "user", "x"), (None, 0, "user", "y"), (None, 5, "user", "y"), (None, 0, "user", "t0")]
    got = op10_chat.collapsed(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert sorted(((r["conv_id"] or -1), r["n_turns"]) for r in got) == [(-1, 1), (1, 3000), (3, 1)]


# -- pipeline --------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def docs(spark):
    near = " ".join(f"v{i}" for i in range(200))
    rows = [(i, t, "en", "abc"[i % 3], None, 7) for i, t in prose(5, 60)] + [(100, near, "en", "a", None, 7), (101, near + " tail", "en", "b", None, 7), (100, near, "en", "a", None, 7)]
    rows += [(102, None, None, None, None, 7), (103, "", "en", "a", None, 7), (None, "text without an id " * 9, "en", "c", None, 7), (104, " ".join(f"l{i % 4999}" for i in range(60_000)), "en", "c", None, 7)]
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").where("length(text) > 100").first()["text"]
    rows += [(105, item, "en", "a", None, 7), (106, "Before that. " + item + " After that.", "en", "b", None, 7)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, __score int").cache()


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def ids(rows):
    return collections.Counter(r["doc_id"] for r in rows)


@pytest.mark.parametrize("name", ["quality", "near_duplicates", "decontamination", "mixing"])
def test_stages_keep_columns_and_take_empty_tables(spark, docs, name):
    extra = docs.withColumnRenamed("__score", "low" if name == "quality" else "__score")
    got = stage(name)(spark, extra, DATA)
    assert got.columns == extra.columns
    assert stage(name)(spark, extra.limit(0), DATA).collect() == []


def test_quality_keeps_what_scores_well(spark, docs):
    plain = docs.drop("__score")
    scores = {(r["doc_id"], r["text"]): r["__score"] for r in op2_quality.scored(plain, op2_quality.fit(plain, spark.read.parquet(f"{DATA}/labels.parquet"))).collect()}
    got = ids(stage("quality")(spark, plain, DATA).collect())
    assert got == collections.Counter(r["doc_id"] for r in plain.collect() if scores[r["doc_id"], r["text"]] >= 0.7)


def test_near_duplicates_keep_the_first_of_each_component(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = components(dict(r for r in rows if r[0] not in (None, 104)).items(), 5, 80)
    got = ids(stage("near_duplicates")(spark, docs, DATA).collect())
    assert got == collections.Counter([d for d, (_, c) in want.items() if d == c] + [None, 104])


def test_decontamination_drops_benchmark_text_only(spark, docs):
    got = ids(stage("decontamination")(spark, docs, DATA).collect())
    assert ids(docs.collect()) - got == collections.Counter([105, 106])


def test_mixing_meets_its_targets_in_whole_documents(spark, docs):
    rows = docs.where("doc_id is null or doc_id <> 104")
    got = stage("mixing")(spark, rows, DATA)
    n = F.coalesce(F.size(F.expr("regexp_extract_all(text, '[^ \\t-\\r]+', 0)")), F.lit(0))
    words = {r["source"]: r["n"] for r in got.groupBy("source").agg(F.sum(n).alias("n")).collect()}
    sources = op1_mixing.mix(rows).sources.collect()
    longest = rows.select(F.max(n)).first()[0]
    assert all(abs(words.get(s["source"], 0) - s["target"]) <= longest / 2 + 1 for s in sources)
    assert max(ids(got.collect()).values()) <= 6 and ids(got.collect())[100] <= 6


def test_sharding_gives_every_row_a_place(spark, docs):
    got = stage("sharding")(spark, docs, DATA).toPandas()
    assert len(got) == docs.count()
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_the_whole_chain(spark):
    out = corpus_pipeline.run(spark, DATA).toPandas()
    known = {r["doc_id"]: len((r["text"] or "").encode()) + 1 for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert len(out) and all(known[r.doc_id] == r.size for r in out.itertuples())
    assert out["doc_id"].value_counts().max() <= 3
