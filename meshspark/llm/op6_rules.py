"""Quality rules as a learned decision list (DataFrame functions only).

Statistics of every whole text are computed by built-in functions.  Sequential covering learns the list from the
statistics of labelled rows: conjunctions of thresholds are grown on two thirds of a sample by information gain,
pruned on the other third, and kept while they are precise; covered rows are set aside and the next rule is
grown.  The list becomes one ordered Spark conditional expression.  The sample holds the SAMPLE rows of each
label that are smallest by a hash of the id, of at most SAMPLE_BYTES bytes each, not held out (crc32(doc_id) mod
4 is 2); labels and ids are never statistics.

Defined results: null and empty texts have no words and fail the base rule; without labels of both kinds the list
is empty and keeps all; of several labels of one id the smallest counts; repeated rows get equal results; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, staged, table

SAMPLE, SAMPLE_BYTES = 3000, 32768
#: Words of a window whose repetition counts.
SPAN = 8
#: A rule stays while this share of what it rejects is labelled 0, on rows that it wasn't grown on.
PRECISE = 0.9
#: Conditions of a rule at most, thresholds tried for a statistic, rules at most.
CONDITIONS, CUTS, RULES = 4, 40, 12
#: Rows labelled 0 that a rule covers at least where it is grown and where it is tested, and splits tried for a rule.
SUPPORT, TRIES = (5, 3), 8
SPACE = "[\\x20\\x09-\\x0D]"


def _covered(w: Column) -> Column:
    """Words in SPAN-word windows that occur twice or more among the words ``w``."""

    def found(h: Column) -> Column:
        def by_hash(s: Column) -> Column:
            twice = F.filter(s, lambda e, j: F.coalesce(F.get(s, j - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False)))
            places = F.array_sort(F.transform(twice, lambda e: e["i"]))
            start = F.struct(F.lit(-SPAN).alias("to"), F.lit(0).alias("n"))
            return F.aggregate(places, start, lambda a, p: F.struct(p.alias("to"), (a["n"] + F.least(F.lit(SPAN), p - a["to"])).alias("n")), lambda a: a["n"])

        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(ordered, by_hash))

    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - SPAN + 1), lambda i: F.xxhash64(F.slice(w, i, SPAN)))
    return F.when(F.size(w) <= SPAN, 0).otherwise(let(hashes, found))


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) without text, with the base counts and the statistics that rules test."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, SPACE + "+"), lambda x: x != "")

    def of(w: Column) -> Column:
        return F.struct(
            F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), _covered(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).alias("distinct"), F.size(F.filter(w, lambda x, i: x == F.get(w, i + 1))).alias("adjacent"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    dup = let(lines, lambda x: F.struct(F.size(x).alias("lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    got = docs.select("*", let(words, of).alias("__w"), dup.alias("__l"), F.regexp_count(text, F.lit("[#*$%&|<>]")).alias("__s"), F.regexp_count(text, F.lit("\\p{Lu}")).alias("__u"), F.regexp_count(text, F.lit("!")).alias("__b"))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    n, chars = F.greatest(F.col("__w.n_words"), F.lit(1)), F.greatest(F.col("__w.word_chars"), F.lit(1))
    return got.select(
        *rest, *[F.col(f"__w.{c}").cast("long").alias(c) for c in ("n_words", "word_chars")], F.col("__s").cast("long").alias("n_symbols"), F.col("__l.dup").cast("long").alias("n_dup_lines"), F.col("__w.n_repeat_words").cast("long").alias("n_repeat_words"),
        (F.col("__s") / n).alias("symbols_a_word"), (F.col("__w.word_chars") / n).alias("chars_a_word"), (F.col("__l.dup") / F.greatest(F.col("__l.lines"), F.lit(1))).alias("dup_lines_share"), (F.col("__w.n_repeat_words") / n).alias("repeat_share"),
        (F.col("__w.distinct") / n).alias("distinct_share"), (F.col("__w.adjacent") / n).alias("adjacent_share"), (F.col("__u") / chars).alias("upper_share"), (F.col("__b") / n).alias("bangs_a_word"), (n / F.greatest(F.col("__l.lines"), F.lit(1))).alias("words_a_line"),
    )


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "symbols_a_word", "chars_a_word", "dup_lines_share", "repeat_share", "distinct_share", "adjacent_share", "upper_share", "bangs_a_word", "words_a_line")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v > self.cut if self.above else v <= self.cut

    def column(self) -> Column:
        return F.col(self.feature) > self.cut if self.above else F.col(self.feature) <= self.cut


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray, weight: np.ndarray) -> Rule:
    """Conditions added by information gain until no good row is covered."""
    rule: Rule = ()
    at = np.ones(len(x), bool)
    while len(rule) < CONDITIONS and (at & ~bad).any():
        p, n = weight[at & bad].sum(), weight[at & ~bad].sum()
        best, gain = None, 1e-6
        for f in FEATURES:
            v = x[at, FEATURES.index(f)]
            for cut in np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 1)[1:-1], method="lower")):
                for above in (True, False):
                    hit = v > cut if above else v <= cut
                    p1, n1 = weight[at][hit & bad[at]].sum(), weight[at][hit & ~bad[at]].sum()
                    if (hit & bad[at]).sum() >= SUPPORT[0] and (g := p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p / (p + n)))) > gain:
                        best, gain = Condition(f, above, float(cut)), g
        if best is None:
            break
        rule += (best,)
        at = at & best.holds(x)
    return rule


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray, weight: np.ndarray) -> Rule:
    """The prefix of the rule with the best (bad - good) / covered on rows it wasn't grown on."""

    def worth(r: Rule) -> float:
        at = _covers(r, x)
        p, n = weight[at & bad].sum(), weight[at & ~bad].sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=())


def learn(x: np.ndarray, bad: np.ndarray, share: float, seed: int = 1) -> list[Rule]:
    """The decision list: rows that a rule covers are rejected.  ``share`` of all labelled rows are bad."""
    rng = np.random.default_rng(seed)
    weight = np.where(bad, share / max(1, bad.sum()), (1 - share) / max(1, (~bad).sum())) * len(x)
    left, rules, tries = np.ones(len(x), bool), [], 0
    while len(rules) < RULES and tries < TRIES:
        grow = rng.random(len(x)) < 2 / 3
        a, b = left & grow, left & ~grow
        if (a & bad).sum() < SUPPORT[0]:
            break
        rule = _prune(_grow(x[a], bad[a], weight[a]), x[b], bad[b], weight[b])
        at = _covers(rule, x)
        tested, whole = at & b, at & left
        fine = rule and (tested & bad).sum() >= SUPPORT[1] and all(weight[r & bad].sum() >= PRECISE * weight[r].sum() for r in (tested, whole))
        if fine:
            rules.append(rule)
            left &= ~at
        tries = 0 if fine else tries + 1
    return rules


def rejected(rules: list[Rule]) -> Column:
    """The list as an ordered conditional expression."""
    out = F.lit(False)
    for rule in reversed(rules):
        both = rule[0].column()
        for c in rule[1:]:
            both = both & c.column()
        out = F.when(both, True).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> list[Rule]:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    known = staged(labels.where(~held).groupBy("doc_id").agg(F.min("quality").cast("int").alias("__label")).where("doc_id is not null and __label in (0, 1)"), "rules-labels")
    counts = {r["__label"]: r["n"] for r in known.groupBy("__label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return []
    picked = [r for y in (0, 1) for r in known.where(F.col("__label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    ids = docs.sparkSession.createDataFrame(picked, known.schema)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where(F.octet_length("text") <= sample_bytes)
    got = sorted(statistics(rows).select("doc_id", "__label", *FEATURES).collect())
    x = np.array([r[2:] for r in got], float).reshape(-1, len(FEATURES))
    return learn(x, np.array([r["__label"] == 0 for r in got], bool), counts[0] / sum(counts.values()))


BASE_FAILED = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every row of ``docs``."""
    got = statistics(docs.select("doc_id", "text")).withColumn("base_failed", F.expr(BASE_FAILED))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~rejected(rules)).alias("kept"))


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules over every row of documents."""
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))
