"""op11: licence phrases and verified licence notices of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import read
from .licenses import LOOKED, PHRASES, SHARE, SLACK, TEMPLATES, labels_of, scan
from .registry import query


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


_TEMPLATES = [(i, label, wording, "|".join(keys)) for i, (label, wording, keys) in enumerate(TEMPLATES)]

SQL = rf"""
with docs as (
  select row_number() over () as row, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
),
templates(t, label, wording, keys) as (values {_values(_TEMPLATES)}),
phrases(label, phrase) as (values {_values(PHRASES)}),
seen as (select row, unnest(w) as word, unnest(range(len(w))) as i from docs),
base as (
  select s.row, s.i as place, p.label from seen s join phrases p on s.word = string_split(p.phrase, ' ')[1] join docs d on d.row = s.row
  where d.w[s.i + 1:s.i + len(string_split(p.phrase, ' '))] = string_split(p.phrase, ' ')
),
bases as (
  select row, count(*) as n_base, min(place) as first_word, max(place) as last_word, string_agg(distinct label, ',' order by label) as base_labels
  from base group by row
),
posted as (select t, label, unnest(string_split(wording, ' ')) as word, unnest(range(len(string_split(wording, ' ')))) as p from templates),
vocabulary as (select distinct word from posted union select distinct unnest(string_split(replace(keys, '|', ' '), ' ')) from templates),
held as (select row, i, word from seen where word in (select word from vocabulary)),
had as (select distinct row, word from held),
counted as (select v.word, count(h.row) as n from vocabulary v left join had h using (word) group by v.word),
needed as (select distinct t, unnest(string_split(replace(keys, '|', ' '), ' ')) as word from templates),
opened as (
  select h.row, n.t from needed n join had h using (word) group by h.row, n.t
  having count(*) = (select count(*) from needed o where o.t = n.t)
),
ranked as (
  select o.row, o.t, d.word, row_number() over (partition by o.row, o.t order by c.n, d.word) as r
  from opened o join (select distinct t, word from posted) d using (t) join had h on h.row = o.row and h.word = d.word join counted c on c.word = d.word
),
chosen as (select row, t, word, count(*) over (partition by row, t) as k from ranked where r <= {LOOKED}),
votes as (
  select distinct c.row, c.t, c.k, c.word, floor((h.i - p.p) / {SLACK})::bigint + e.d as cell
  from chosen c join held h on h.row = c.row and h.word = c.word join posted p on p.t = c.t and p.word = c.word, (values (0), (1)) e(d)
),
agreed as (
  select row, t, (cell - 1) * {SLACK} as start from votes group by row, t, k, cell having count(*) >= ceil(k * {SHARE[0]} / {SHARE[1]})
),
stretches as (
  select a.row, t.label, string_split(t.keys, '|') as keys, list_distinct(string_split(t.wording, ' ')) as words,
    d.w[greatest(a.start, 0) + 1:greatest(a.start, 0) + len(string_split(t.wording, ' ')) + {3 * SLACK} + least(a.start, 0)] as near
  from agreed a join templates t using (t) join docs d on d.row = a.row
),
shares as (
  select row, label, len(list_intersect(words, near))::double / len(words)::double as share from stretches
  where len(list_filter(keys, lambda k: not contains(' ' || array_to_string(near, ' ') || ' ', ' ' || k || ' '))) = 0
),
verified as (select row, label, share from shares where share >= {SHARE[0]}::double / {SHARE[1]}),
labelled as (
  select row, string_agg(distinct label, ',' order by label) as labels, max(share) as score
  from (select row, label, share from verified union all select row, label, 1.0::double from base) group by row
)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(b.n_base, 0)::bigint as n_base, b.first_word::bigint as first_word,
  b.last_word::bigint as last_word, coalesce(b.base_labels, '') as base_labels, coalesce(l.labels, '') as labels, coalesce(l.score, 0)::double as score
from docs d left join bases b using (row) left join labelled l using (row)
"""


@query("op11_license_notices", SQL)
def license_notices(spark, folder):
    found = scan(read(spark, folder, "documents"))
    starts = F.transform("places", lambda p: p["start"].cast("long"))
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels_of(F.col("places")).alias("base_labels"), labels_of(F.col("places"), F.col("matches")).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"),
    )
