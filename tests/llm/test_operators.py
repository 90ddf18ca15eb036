"""Every operator against brute force and on odd rows."""

import collections
import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meshspark.llm import op1_mixing, op2_quality, op3_jaccard, op4_substring, op5_sharding, op6_rules, op7_pii, op8_decontamination, op9_html, op10_chat

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, cid bigint, pos int, key string, score double"


def odd_rows():
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    texts = [None, "", "   \n\t", "one", "a b c d e", long, "a b c d e", "Grüße, " * 40, "x@y.zz +1 (234) 555-1234 10.0.0.1 4111111111111111", "😀 word\x85word\x1cz"]
    rows = [(i, t, "en", "s" if i % 3 else None, None) for i, t in enumerate(texts)] + [(None, "null id text here", None, None, None), (3, "one", "en", "s", None)]
    return [(*r, 7, 8, 9, "k", 0.5) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(None, 1, 0), (4, None, 0)], "doc_id bigint, quality int, toxic int")


def prose(seed, n=60):
    random.seed(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    out = []
    for d in range(n):
        w = [random.choice(vocabulary) for _ in range(random.choice([3, 15, 60, 200]))]
        if out and random.random() < 0.5:
            w = random.choice(out)[1].split()
            for _ in range(random.choice([0, 1, 3])):
                w[random.randrange(len(w))] = random.choice(vocabulary)
        out.append((d, " ".join(w)))
    return out


def components(rows, n, percent):
    low = {d: re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for d, t in rows}
    sets = {}
    for d, t in low.items():
        w = WORDS.findall(t)
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    return {d: (len(sets[d]), root[d]) for d in sets}


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_jaccard_against_brute_force(spark, n, percent):
    rows = prose(n)
    got = op3_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), n, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == components(rows, n, percent)


def test_jaccard_exchanges_signatures_once(spark, monkeypatch):
    plans, staged = {}, op3_jaccard.staged
    monkeypatch.setattr(op3_jaccard, "staged", lambda df, label="step": plans.setdefault(label, df._jdf.queryExecution().executedPlan().toString()) and staged(df, label))
    op3_jaccard.jaccard_components(spark.createDataFrame(prose(3), "doc_id bigint, text string")).count()
    assert len(re.findall(r"Exchange hashpartitioning\(sig", plans["near-found"])) == 1


def test_signatures_come_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(op3_jaccard, "BATCH_SIGNATURES", 1000, raising=False)
    ids, texts = range(30), [" ".join(f"w{i}x{j}" for j in range(200)) for i in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts), pa.array([False] * 30)], ["own", "text", "several"])
    got = list(op3_jaccard._signed(5, 80)(iter([batch])))
    assert [w for b in got for w in b.column("who").to_pylist()] == list(ids)
    assert max(len(b.column("sigs").values) for b in got) < 2000 and len({len(s) for b in got for s in b.column("sigs").to_pylist()}) == 1


def cut(rows, n=20):
    seen, out = set(), {}
    for d, t in sorted(rows):
        w = WORDS.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            if k in seen:
                gone[i : i + n] = [True] * n
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substring_against_brute_force(spark):
    random.seed(9)
    rows = [(d, t if d % 4 else "x y " * random.choice([5, 10, 40]) + t + " z" * random.choice([2, 19, 20, 50])) for d, t in prose(8, 80)]
    got = op4_substring.repeats(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()} == cut(rows)


def test_mix_takes_its_targets(spark):
    rows = [(i, "w " * (i % 37), "abc"[i % 3] if i % 10 else None) for i in range(400)]
    m = op1_mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).documents.toPandas()
    by = m.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "max"))
    assert len(m) == 400 and (m["taken"] <= 3 * m["size"]).all() and ((by["taken"] - by["target"]).abs() <= 1).all()
    assert abs(by["target"].sum() - m["size"].sum()) < 1e-6


def test_shards_are_minimal_and_gapless(spark):
    rows = [(i, "t" * ((i * 7919) % 500 + 1)) for i in range(300)] + [(1000 + i, "copy" * 50) for i in range(40)]
    got = op5_sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string"), 4).toPandas()
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert got[got["doc_id"] >= 1000]["shard"].nunique() == 1
    # The least capacity over the same order of groups, by trying all.
    keyed = spark.createDataFrame(rows, "doc_id bigint, text string").groupBy(F.xxhash64("text").alias("k")).agg(F.sum(F.octet_length("text") + 1).alias("n")).orderBy("k")
    sizes = [r["n"] for r in keyed.collect()]

    def fits(c):
        n, room = 1, c
        for s in sizes:
            if s > room:
                n, room = n + 1, c
            room -= s
        return n <= 4

    least = next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))
    assert got.groupby("shard")["size"].sum().max() == least


def test_decontamination_in_blocks(spark):
    random.seed(2)
    items = [(i, " ".join(f"q{random.randrange(50)}" for _ in range(random.choice([2, 13, 40])))) for i in range(12)] + [(None, "null item words"), (99, None)]
    docs = [(d, ("Intro, " + items[d % 12][1].upper().replace(" ", "; ") + " end") if d % 2 else f"clean text {d}") for d in range(30)]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    whole = op8_decontamination.decontaminate(d, b).orderBy("doc_id").collect()
    assert op8_decontamination.decontaminate(d, b, limit=300).orderBy("doc_id").collect() == whole
    assert all(r["contaminated"] == bool(r["doc_id"] % 2) for r in whole)
    text = dict(docs)
    assert all(op8_decontamination.normal_words(text[r["doc_id"]][s["start"] : s["end"]]) for r in whole for s in r["spans"])


def test_rules_count_as_brute_force(spark):
    texts = ["a b c d e f g h a b c d e f g h a", "x " * 30, "l1\nl1\n\nl2\nl1 ", "# $ a|b", "one two"]
    got = op6_rules.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), []).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        w = WORDS.findall(t)
        c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))


def test_rules_are_learned(spark):
    docs = [(i, ("good words of every kind " * 8 if i % 3 else "### $$$ %%% junk " * 12)) for i in range(300)]
    rules = op6_rules.fit(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id bigint, quality int"))
    assert rules


def test_personal_data_spans(spark):
    base = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    random.seed(3)
    rows = [(i, "".join(random.choice(["a", "é", "@", ".", "12", "+1", " 234 ", "-", "😀", "x@y.zz", "\n"]) for _ in range(40))) for i in range(300)]
    got = {r["doc_id"]: r["base"] for r in op7_pii.spotted(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, t in rows:
        want = [(m.start(), m.end()) for m in re.finditer(base["email"], t)]
        assert [(s["start"], s["end"]) for s in got[i] if s["kind"] == "email"] == want
        want = [(m.start(), m.end()) for m in re.finditer(base["phone"], t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert [(s["start"], s["end"]) for s in got[i] if s["kind"] == "phone"] == want


def test_html_keeps_the_article():
    page = """<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies.</div>
    <article><h1>Title</h1><p>First &amp; <b>bold</b>&nbsp;text.<p>Second.<form><input><label>Mail</label></form><ul><li>Item</li></ul><div class=comments><p>Nice!</p></div></article><aside>More</aside><footer>&copy; x</footer></body></html>"""
    assert op9_html.extract(page) == "Title\n\nFirst & bold text.\n\nSecond.\n\nItem"
    assert op9_html.extract(None) == op9_html.extract("") == ""


PROSE = "It was in the spring of the year that they came to the house by the river, and she had not been there before. " * 3


def test_html_judges_pages_without_an_article():
    links = "".join(f"<li><a href=x>Another page of this site, number {i}, with a long name to click on</a></li>" for i in range(4))
    junk = "<div>" + "xq zzt kkr vvp " * 20 + "</div>"
    page = f"<body><ul>{links}</ul>{junk}<p>Before.</p>{junk}<h2>Head</h2><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p>{junk}<p>After.</p></body>"
    assert op9_html.extract(page) == "\n\n".join(["Head", PROSE.strip(), "Short.", PROSE.strip()])


def test_html_takes_an_article_as_evidence_only():
    # a name such as entry-title is no article, and main text outside an article stays
    assert op9_html.extract(f'<div class="entry-title">The title of it</div><p>{PROSE}</p><p>{PROSE}</p>').count("spring") == 6
    assert op9_html.extract(f"<h1>Title</h1><article><p>{PROSE}</p></article><p>{PROSE}</p><p>Imprint</p>") == "\n\n".join(["Title", PROSE.strip(), PROSE.strip()])
    # in an article, text with few stop words goes with its neighbours, and a short text between link lists is bad
    link = "<p><a href=x>Another page of this site with a long name to click on</a></p>"
    few = "Chrome steel, brass, copper, nickel, cobalt, zinc, cadmium, mercury, gallium, indium, thallium."
    assert op9_html.extract(f"<article><h1>Title</h1><p>{PROSE}</p><p>{few}</p>{link}<p>More:</p>{link}</article>") == "\n\n".join(["Title", PROSE.strip(), few])


def test_html_keeps_languages_without_known_stop_words():
    russian = "Весной того года они пришли к дому у реки, где прежде никто из них ещё не бывал. " * 3
    finnish = "Keväällä he saapuivat talolle joen rannalle, jossa kukaan heistä ei ollut aikaisemmin käynyt. " * 3
    chinese = "那年春天，他们来到河边的房子，以前谁也没有到过这里。" * 4
    link = "<p><a href=x>Another page of this site with a long name to click on</a></p>"
    for text in (russian, finnish, chinese):
        assert op9_html.extract(f"<body>{link}<p>{text}</p><p>{text}<a href=x>x</a></p>{link}</body>").count(text.strip()) == 2
        assert op9_html.extract(f"<body><p>{text} <a href=x>x</a></p></body>").startswith(text.strip())


def test_snapshots_collapse(spark):
    turns = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (4, 0, "user", "hi there"), (5, 0, None, None)]
    got = op10_chat.collapsed(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"))
    assert sorted(r["conv_id"] for r in got.collect()) == [2, 4, 5]


def test_classifier_tells_letters_from_symbols():
    import pyarrow as pa

    texts = [b"plain words in a row " * (i % 9 + 2) if i % 2 else b"#$% @@ || ~~ ^^ " * (i % 9 + 2) for i in range(120)]
    m = op2_quality.train(texts, [i % 2 for i in range(120)], 0.5)
    s = op2_quality.scores(m, pa.array([t.decode() for t in texts] + ["", None]))
    assert all((x > 0.5) == bool(i % 2) for i, x in enumerate(s[:120])) and s[120] == s[121]


def run_all(docs, labels, spark):
    bench = spark.createDataFrame([(1, "a b c d e"), (2, None)], "item_id bigint, text string")
    return {
        1: lambda: op1_mixing.mix(docs).documents, 2: lambda: op2_quality.score(docs, op2_quality.fit(docs, labels)), 3: lambda: op3_jaccard.jaccard_components(docs), 4: lambda: op4_substring.repeats(docs), 5: lambda: op5_sharding.shard(docs),
        6: lambda: op6_rules.judge(docs, op6_rules.fit(docs, labels)), 7: lambda: op7_pii.find(docs), 8: lambda: op8_decontamination.decontaminate(docs, bench),
    }


@pytest.mark.parametrize("op", range(1, 9))
def test_odd_rows(spark, odd, none, labels, op):
    got = run_all(odd, labels, spark)[op]().collect()
    assert len(got) == len(odd_rows())
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r[0] for r in odd_rows())
    assert run_all(none, labels, spark)[op]().collect() == []


def test_odd_pages_and_turns(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "u", "", "x"), (2, "u", "<p>text", "x"), (2, "u", "<p>text", "x")], "page_id bigint, url string, html string, text string")
    assert op9_html.main_texts(pages).count() == 4 and op9_html.main_texts(pages.limit(0)).count() == 0
    turns = spark.createDataFrame([(None, None, None, None, 1), (1, 0, "user", "a", 1), (1, 0, "user", "a", 1)], "conv_id bigint, turn bigint, role string, text string, n_turns int")
    assert op10_chat.collapsed(turns).count() == 2 and op10_chat.collapsed(turns.limit(0)).count() == 0


def test_unique_keeps_one_of_a_group(spark):
    t = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(1, t, 5), (2, t + " more", 5), (3, "other text of its own", 5), (None, t, 5), (3, "other text of its own", 5)], "doc_id bigint, text string, low int")
    got = op3_jaccard.unique(docs).collect()
    assert collections.Counter(r["doc_id"] for r in got) == {1: 1, 3: 1, None: 1} and got[0].asDict().keys() == {"doc_id", "text", "low"}


def test_jaccard_links_texts_of_a_repeated_id(spark):
    x, y = " ".join(f"x{i}" for i in range(100)), " ".join(f"y{i}" for i in range(100))
    docs = spark.createDataFrame([(3, y), (5, y), (5, x), (9, x + " more")], "doc_id bigint, text string")
    for small in (op3_jaccard.SMALL, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(op3_jaccard, "SMALL", small)
            got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in op3_jaccard.jaccard_components(docs).collect())
        assert got == [(3, 98, 3), (5, 98, 3), (5, 98, 5), (9, 99, 5)]


def test_unique_decides_repeated_ids_by_text(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(100)) for c in "xyz")
    docs = spark.createDataFrame([(3, y, 1), (5, y, 1), (5, x, 1), (5, z, 1), (5, z, 1), (9, x + " more", 1), (7, "", 1), (7, None, 1)], "doc_id bigint, text string, low int")
    got = sorted((r["doc_id"], (r["text"] or "")[:1]) for r in op3_jaccard.unique(docs).collect())
    assert got == [(3, "y"), (5, "x"), (5, "z"), (7, "")]


def test_secret_is_proposed_however_late_its_first_digit(spark):
    tokens = ["k" * 80 + "7", "7" * 80 + "k", "ab12cd34ef56"]
    rows = spark.createDataFrame([(t,) for t in [*tokens, "k" * 80, "7" * 80]], "text string")
    got = [r[0] for r in rows.select(F.regexp_extract("text", op7_pii.WIDE["secret"], 0)).collect()]
    assert got == [*tokens, "", ""]
