"""Chat formatting with cumulative-snapshot collapse.

Loggers often write a conversation again after each turn.  Every conversation's turns are hashed in a rolling way:
the k-th hash stands for its first k turns.  A conversation whose whole hash is the hash of a proper prefix of
another one is a snapshot and goes by an anti-join; of equal conversations the smallest id stays.  What remains is
rendered turn by turn.

Defined results: turns are ordered by turn, then role, then text, nulls last; a null text renders as empty, a null
role as 'unknown'; a row of null conv_id is a conversation of one turn, and of equal ones one stays unless one with
an id does; repeated rows are repeated turns; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

#: Around a turn; the role goes between the first two.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _rolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (conv_id, turns): conv_id, n_turns, text (rendered), whole (hash), prefixes (hashes of its proper prefixes)."""
    for batch in batches:
        n, shown, whole, prefixes = [], [], [], []
        for turns in batch.column(1).to_pylist():
            parts, hashes, last = [], [], b""
            for t in turns:
                role, text = t["role"] if t["role"] is not None else "unknown", t["text"] or ""
                parts.append(f"{OPEN}{role}{MIDDLE}{text}{CLOSE}")
                own = hashlib.md5(role.encode()).digest() + text.encode("utf-8", "surrogatepass")
                hashes.append(last := hashlib.md5(last + hashlib.md5(own).digest()).digest())
            n.append(len(turns))
            shown.append("".join(parts))
            whole.append(hashes.pop())
            prefixes.append(hashes)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(shown, pa.string()), pa.array(whole, pa.binary()), pa.array(prefixes, pa.list_(pa.binary()))], ["conv_id", "n_turns", "text", "whole", "prefixes"])


def collapsed(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, text of the maximal conversations of ``conversations`` (conv_id, turn, role, text)."""
    one = F.struct("turn", "role", "text")
    named = conversations.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    alone = conversations.where("conv_id is null").select("conv_id", F.array(one).alias("turns"))
    kind = dict(conversations.dtypes)["conv_id"]
    shape = f"conv_id {kind}, n_turns bigint, text string, whole binary, prefixes array<binary>"
    c = staged(named.mapInArrow(_rolled, shape).unionByName(alone.mapInArrow(_rolled, shape).dropDuplicates(["whole"])), "chat-rolled")
    prefixes = c.select(F.explode("prefixes").alias("whole")).distinct()
    first = c.groupBy("whole").agg(F.min("conv_id").alias("first"))
    kept = first.join(prefixes, "whole", "left_anti")
    return c.join(kept, (c["whole"] == kept["whole"]) & c["conv_id"].eqNullSafe(kept["first"])).select("conv_id", "n_turns", "text")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every maximal conversation, rendered."""
    return collapsed(table(spark, sf_dir, "conversations"))


ORACLE = """
with r as (select *, coalesce(conv_id::varchar, 'row ' || row_number() over ()) as g from conversations),
t as (
  select g, conv_id, row_number() over (partition by g order by turn nulls last, role nulls last, text nulls last) as k,
         '<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) as shown,
         md5(md5(coalesce(role, 'unknown')) || coalesce(text, '')) as own
  from r),
c as (select g, min(conv_id) as conv_id, count(*) as n_turns, string_agg(shown, '' order by k) as text, string_agg(own, '' order by k) as canon from t group by g),
p as (select distinct left(canon, 32 * i::int) as canon from (select canon, unnest(range(1, n_turns)) as i from c)),
f as (select canon, arg_min(g, coalesce(conv_id, 9223372036854775807)) as first from c group by canon)
select c.conv_id, c.n_turns, c.text
from c join f on c.canon = f.canon and c.g = f.first
where c.canon not in (select canon from p)
"""
