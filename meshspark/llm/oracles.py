"""DuckDB SQL for the queries whose every column the contract fixes."""

from __future__ import annotations

import string

LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
WORD = r"[^\x20\x09-\x0D]+"
NORMAL_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Near equal documents: equal sets are one node, links come from a self-join over shared shingles.
JACCARD = rf"""with recursive w as (select doc_id, regexp_extract_all({LOWER}, '{WORD}') as w from documents),
s as (select doc_id, list_sort(list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as s from w),
k as (select doc_id, len(s) as n, s, min(doc_id) over (partition by md5(array_to_string(s, chr(9))), len(s)) as c from s),
one as materialized (select c, n, unnest(s) as x from k where doc_id = c and n > 0),
link as materialized (select a.c as a, b.c as b from one a join one b on a.x = b.x and a.c < b.c group by a.c, b.c, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
both_ways as (select a, b from link union all select b, a from link),
cc as (select distinct c as a, c as b from one union select cc.a, t.b from cc join both_ways t on t.a = cc.b),
low as (select a, min(b) as component_id from cc group by a)
select doc_id, n as n_shingles, case when n = 0 then doc_id else component_id end as component_id from k left join low on low.a = k.c"""

#: Repeated windows: a row number over equal windows, and the words that the later ones cover.
SUBSTRING = rf"""with w as materialized (select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 19], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from w)),
rep as (select doc_id, i from (select doc_id, i, row_number() over (partition by k order by doc_id, i) as n from win) where n > 1),
gone as materialized (select distinct doc_id, unnest(range(i, i + 20)) as j from rep),
kept as (select doc_id, string_agg(x, ' ' order by j) as kept from (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as j from w) anti join gone using (doc_id, j) group by 1),
cut as (select doc_id, count(*) as n from gone group by 1)
select w.doc_id, len(w) as n_words, coalesce(cut.n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join cut on cut.doc_id = w.doc_id left join kept on kept.doc_id = w.doc_id"""

#: Benchmark text: windows of every length that the items have, joined as strings.
DECONTAMINATION = rf"""with d as materialized (select doc_id, regexp_extract_all({LOWER}, '{NORMAL_WORD}') as w from documents),
q as (select item_id, regexp_extract_all({LOWER}, '{NORMAL_WORD}') as w from benchmark),
iw as materialized (select distinct item_id, least(13, len(w)) as l, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') as k from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from q where len(w) > 0)),
dw as (select doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') as k from (select doc_id, w, l, unnest(range(1, len(w) - l + 2)) as i from d, (select distinct l from iw))),
hit as materialized (select dw.doc_id, dw.i, dw.l, iw.item_id from dw join iw on dw.l = iw.l and dw.k = iw.k),
words as (select doc_id, count(*) as n from (select distinct doc_id, unnest(range(i, i + l)) as j from hit) group by 1),
items as (select doc_id, count(*) as n, string_agg(id, ',' order by id) as ids from (select distinct doc_id, item_id::varchar as id from hit) group by 1)
select d.doc_id, len(w) as n_words, coalesce(words.n, 0) as n_hit, coalesce(items.n, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(words.n, 0) > 0 and 20 * coalesce(words.n, 0) >= len(w) as contaminated from d left join words on words.doc_id = d.doc_id left join items on items.doc_id = d.doc_id"""
