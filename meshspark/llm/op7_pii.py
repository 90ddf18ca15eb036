"""Personal data by weak supervision (DataFrame functions only).

Base rules find e-mail addresses, IP addresses, card and phone numbers.  Wider patterns propose further spans:
secrets, phone and card numbers that the base rules lose, social security and bank account numbers.  On each proposed span four labelers
vote: a strict pattern, a gazetteer of key words before it and of known beginnings, its context (an assignment, a label or a sign in front), and
its shape.  Expectation-maximisation over the counts of vote patterns in all documents estimates how reliable
each labeler is.  The span classifier is trained on the posteriors: logistic in the votes, and, by a second fit, in
traits of the span and the words around it that no labeler looks at (length, share of digits, letter case, variety
of characters, separators, a plain word in front).  Traits tell true from false spans beyond the votes, so the two
fits add up; its expression decides which proposed spans are added.  What reaches the driver is one count for each
kind, vote pattern and pattern of traits, 5120 at most.

Spans are code points, end exclusive.  A proposed span that touches a base span, or an accepted one of an earlier
kind, is dropped.

Defined results: null and empty texts have no spans; repeated rows get equal results; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, staged, table

#: Base patterns.  Each is the contract's pattern, made linear: a match starts where its run of characters starts
#: or where the last match ended, and takes whole runs.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a base pattern to be tried.
HINT = {"email": "@", "ip": None, "card": None, "phone": "+"}
#: Proposed spans.
WIDE = {
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{12,}+",
    "other_phone": r"(?<![0-9A-Za-z+(-])(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
    "other_card": r"(?<![0-9])[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
}
#: Strict patterns.
STRICT = {
    "secret": r"^(?:[0-9a-f]{16,}|[0-9A-F]{16,}|AKIA[0-9A-Z]{16}|(?:ghp|gho|ghs|xox[abp]|sk|pk|rk)[_-][A-Za-z0-9_-]{16,})$",
    "other_phone": r"^(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([2-9][0-9]{2}\)\x20|[2-9][0-9]{2}[.-])[0-9]{3}[.-][0-9]{4}$",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "iban": r"^[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}",
}
#: Words that name the kind, sought in the characters before a span.
GAZETTEER = {
    "secret": r"(?i)(?:password|passwd|passwort|pwd|secret|token|api.?key|access.?key|auth|bearer|credential|contrase|mot de passe|clave)",
    "other_card": r"(?i)(?:card|visa|master|amex|karte|carte|tarjeta)",
    "other_phone": r"(?i)(?:phone|tel|call|mobile|cell|fax|handy|appel|llam)",
    "ssn": r"(?i)(?:ssn|social|security)",
    "iban": r"(?i)(?:iban|account|konto|cuenta|compte|bic)",
}
#: Beginnings of spans that are known for the kind.
KNOWN = {
    "secret": r"^(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|xox[abp]-|sk-|sk_live_|pk_live_|AIza|glpat-|eyJ)",
    "other_phone": r"^\+(?:1|33|34|44|49)[\x20.-]",
    "other_card": r"^(?:4|5[1-5]|2[2-7])",
    "ssn": r"^(?!)",
    "iban": r"^(?:DE|ES|FR|GB|IT|NL|BE|AT|CH|PT)",
}
CONTEXT = r"""[=:#]\x20?["'(]?$"""
#: Characters before a span that labelers see.
BEFORE = 24
LABELERS, TRAITS = 4, 6
#: How far traits may move the logit of a span.
TRAIT_REACH = 2.0
KINDS = [*BASE, *WIDE]
SPAN = "struct<start:int,end:int,text:string>"


def matches(text: Column, pattern: str, hint: Column | None = None) -> Column:
    """All matches of a pattern with their code point spans, in order."""
    none = F.array().cast(f"array<{SPAN}>")

    def placed(m: Column) -> Column:
        def add(s: Column) -> Column:
            start = F.struct(F.lit(0).alias("at"), none.alias("out"))

            def step(a: Column, i: Column) -> Column:
                begin = a["at"] + F.get(s, i)
                end = begin + F.length(F.get(m, i))
                return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), F.get(m, i).alias("text")))).alias("out"))

            return F.aggregate(F.sequence(F.lit(0), F.size(m) - 1), start, step, lambda a: a["out"])

        return F.when(F.size(m) == 0, none).otherwise(let(F.transform(F.split(text, pattern, -1), F.length), add))

    got = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    return got if hint is None else F.when(hint, got).otherwise(none)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    def total(d: Column) -> Column:
        def add(a: Column, i: Column) -> Column:
            v = F.ascii(F.substr(d, F.length(d) - i, F.lit(1))) - 48
            twice = F.when(v > 4, 2 * v - 9).otherwise(2 * v)
            return a + F.when(i % 2 == 1, twice).otherwise(v)

        n = F.length(d)
        return F.when((n >= 12) & (n <= 19), F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0).otherwise(False)

    return let(_digits(x), total)


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(x, "\\."), lambda p: (F.length(bare(p)) <= 3) & (F.coalesce(bare(p).try_cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        return _luhn(x)
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    return F.lit(True)


def _votes(kind: str, before: Column, x: Column) -> Column:
    """The labelers' votes as a bit word."""
    digits, n = F.length(_digits(x)), F.length(x)
    shape = {
        "secret": (digits * 20 >= n) & (digits * 20 <= n * 19) & (n >= 16),
        "other_card": x.rlike("^[3-6]"),
        "other_phone": F.size(F.array_distinct(F.split(_digits(x), ""))) >= 4,
        "ssn": F.size(F.array_distinct(F.split(_digits(x), ""))) >= 4,
        "iban": F.length(F.regexp_replace(x, " ", "")).between(15, 34) & (digits * 2 >= n),
    }[kind]
    strict = _luhn(x) if kind == "other_card" else x.rlike(STRICT[kind])
    votes = [strict, before.rlike(GAZETTEER[kind]) | x.rlike(KNOWN[kind]), before.rlike(CONTEXT) | x.rlike("^\\+"), shape]
    out = F.lit(0)
    for i, v in enumerate(votes):
        out = out + F.when(v, 1 << i).otherwise(0)
    return out


def _traits(before: Column, x: Column) -> Column:
    """What a span looks like, as a bit word; no labeler votes on it."""
    digits, n = F.length(_digits(x)), F.length(x)
    traits = [n >= 24, digits * 2 >= n, x.rlike("[A-Z]") & x.rlike("[a-z]"), F.size(F.array_distinct(F.split(x, ""))) >= 10, x.rlike("[\\x20./_-]"), before.rlike("(?:^|\\x20)[a-z]{2,}\\x20$")]
    out = F.lit(0)
    for i, t in enumerate(traits):
        out = out + F.when(t, 1 << i).otherwise(0)
    return out


def _checked(kind: str, order: int, found: Column) -> Column:
    good = F.filter(found, lambda m: _valid(kind, m["text"]))
    return F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def _judged(kind: str, order: int, text: Column, found: Column) -> Column:
    def one(m: Column) -> Column:
        before = F.substring(text, F.greatest(m["start"] - BEFORE, F.lit(0)) + 1, F.least(m["start"], F.lit(BEFORE)))
        return F.struct(m["start"].alias("start"), F.lit(order).alias("order"), m["end"].alias("end"), F.lit(kind).alias("kind"), _votes(kind, before, m["text"]).alias("votes"), _traits(before, m["text"]).alias("traits"))

    return F.transform(found, one)


def spotted(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans by kind) and wide (proposed spans with votes) of every row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    some = F.col("__t").rlike("[0-9]")
    rows = docs.select("doc_id", text.alias("__t"))
    base = []
    for k, kind in enumerate(BASE):
        hint = F.contains(F.col("__t"), F.lit(HINT[kind])) if HINT[kind] else some
        base.append(_checked(kind, k, matches(F.col("__t"), BASE[kind], hint)))
    wide = []
    for k, kind in enumerate(WIDE, len(BASE)):
        wide.append(_judged(kind, k, F.col("__t"), matches(F.col("__t"), WIDE[kind], some)))
    rows = rows.select("doc_id", F.array_sort(F.concat(*base)).alias("base"), F.concat(*wide).alias("wide"))
    clear = F.filter("wide", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    return rows.withColumn("wide", clear)


@dataclass(frozen=True)
class SpanModel:
    bias: dict[str, float]
    weight: tuple[float, ...]
    traits: dict[str, tuple[float, ...]]  # of each kind: a shift, then one weight for each trait

    def accepts(self, span: Column) -> Column:
        z = F.lit(-1.0)
        for kind, b in self.bias.items():
            z = F.when(span["kind"] == kind, b).otherwise(z)
        for i, w in enumerate(self.weight):
            z = z + F.when(span["votes"].bitwiseAND(1 << i) > 0, w).otherwise(0.0)
        looks = F.lit(0.0)
        for kind, (shift, *own) in self.traits.items():
            y = F.lit(shift)
            for i, w in enumerate(own):
                y = y + F.when(span["traits"].bitwiseAND(1 << i) > 0, w).otherwise(0.0)
            looks = F.when(span["kind"] == kind, y).otherwise(looks)
        return z + F.greatest(F.lit(-TRAIT_REACH), F.least(F.lit(TRAIT_REACH), looks)) >= 0


#: Beliefs before data: how often a labeler votes for a true and for a false span, and their weight beside the
#: counts, which keeps the classes apart where nearly all proposed spans are true, or false.
BELIEF, BELIEF_SHARE = (0.1, 0.8), 0.5


def em(counts: dict[tuple[str, int], int], rounds: int = 50) -> dict[tuple[str, int], float]:
    """The posterior of every (kind, votes), by two classes of independent labelers with a share for each kind."""
    bits = {v: [v >> i & 1 for i in range(LABELERS)] for v in range(1 << LABELERS)}
    kinds = sorted({k for k, _ in counts})
    total = sum(counts.values())
    strength = 10 + BELIEF_SHARE * total
    rate = [[b] * LABELERS for b in BELIEF]
    share = {k: [1.0, 1.0] for k in kinds}
    post: dict[tuple[str, int], float] = {}
    for _ in range(rounds):
        for k in kinds:
            for v, b in bits.items():
                z = math.log(share[k][1] / share[k][0])
                z += sum(math.log(rate[1][i] / rate[0][i]) if x else math.log((1 - rate[1][i]) / (1 - rate[0][i])) for i, x in enumerate(b))
                post[k, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        for c in (0, 1):
            mass = {kv: n * (post[kv] if c else 1 - post[kv]) for kv, n in counts.items()}
            rate[c] = [(strength * BELIEF[c] + sum(m * bits[v][i] for (_, v), m in mass.items())) / (strength + sum(mass.values())) for i in range(LABELERS)]
            for k in kinds:
                own = sum(n for (kind, _), n in counts.items() if kind == k)
                share[k][c] = 5 + own + sum(m for (kind, _), m in mass.items() if kind == k)
    return post


def _logistic(rows: list[tuple[list[int], float, float]], w: list[float], steps: int, decay: float = 0.0) -> list[float]:
    """Bias and weights fitted to rows (features, target, share), from those given."""
    for _ in range(steps):
        g = [0.0] + [decay * x for x in w[1:]]
        for x, p, n in rows:
            z = w[0] + sum(a for a, b in zip(w[1:], x, strict=True) if b)
            d = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p) * n
            g[0] += d
            for i, b in enumerate(x, 1):
                g[i] += d * b
        w = [a - 2.0 * b for a, b in zip(w, g, strict=True)]
    return w


def train(counts: dict[tuple[str, int, int], int], steps: int = 1500) -> SpanModel:
    """The span classifier, from the counts of (kind, votes, traits), fitted to the posteriors."""
    if not counts:
        return SpanModel({}, (0.0,) * LABELERS, {})
    votes: dict[tuple[str, int], int] = {}
    for (k, v, _), n in counts.items():
        votes[k, v] = votes.get((k, v), 0) + n
    post, kinds = em(votes), sorted({k for k, _ in votes})
    total = sum(votes.values())
    rows = []
    for (k, v), p in post.items():
        rows.append(([*(int(k == x) for x in kinds), *(v >> i & 1 for i in range(LABELERS))], p, votes.get((k, v), 0) / total + 0.5 / len(post)))
    common, *fit = _logistic(rows, [0.0, *[-2.0] * len(kinds), *[1.0] * LABELERS], steps)
    weight = fit[len(kinds) :]
    # No labeler decides alone.
    top = max(weight)
    bias = {k: min(common + b, -top - 1e-6) for k, b in zip(kinds, fit, strict=False)}
    traits = {}
    for kind in kinds:
        own: dict[int, list[float]] = {}
        for (k, v, t), n in counts.items():
            if k == kind:
                at = own.setdefault(t, [0.0, 0.0])
                at[0] += n
                at[1] += n * post[k, v]
        size, true = sum(n for n, _ in own.values()), sum(p for _, p in own.values())
        share = min(max((true + 1) / (size + 2), 1e-3), 1 - 1e-3)
        prior = math.log(share / (1 - share))
        # A pattern of traits counts for what sets it apart from the kind's others; few spans tell little.
        _, *own_weights = _logistic([([t >> i & 1 for i in range(TRAITS)], p / n, n / size) for t, (n, p) in own.items()], [prior, *[0.0] * TRAITS], 300, 1.0 / math.sqrt(size + 1))
        mean = sum(n * sum(w for i, w in enumerate(own_weights) if t >> i & 1) for t, (n, _) in own.items()) / size
        traits[kind] = (-mean, *own_weights)
    return SpanModel(bias, tuple(weight), traits)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (start, order, end, kind) of every row of ``docs`` (doc_id, text)."""
    rows = staged(spotted(docs.select("doc_id", "text")), "pii-spans")
    got = rows.select(F.explode("wide").alias("w")).groupBy(F.col("w.kind").alias("kind"), F.col("w.votes").alias("votes"), F.col("w.traits").alias("traits")).agg(F.count("*").alias("n")).collect()
    model = train({(r["kind"], r["votes"], r["traits"]): r["n"] for r in sorted(got)})
    good = F.filter("wide", model.accepts) if model.bias else F.col("wide")
    rows = rows.withColumn("wide", good)
    first = F.filter("wide", lambda w: ~F.exists("wide", lambda v: (v["order"] < w["order"]) & (v["start"] < w["end"]) & (w["start"] < v["end"])))
    added = F.transform(first, lambda w: F.struct(w["start"].alias("start"), w["order"].alias("order"), w["end"].alias("end"), w["kind"].alias("kind")))
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def _digest(c: str) -> Column:
    return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str):
    return lambda s: s["kind"] == kind


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every row of documents."""
    got = find(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _is(kind))).cast("long").alias(f"n_{kind}") for kind in BASE]
    return got.select("doc_id", *counts, F.sha2(_digest("base"), 256).alias("base_sha256"), _digest("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
