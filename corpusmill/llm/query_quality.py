"""op5: quality rules and host verdicts for all documents."""

from __future__ import annotations

from .common import read
from .quality import COUNTS, judged
from .registry import query

SQL = r"""
with words as (
  select row_number() over () as row, doc_id, source, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents
),
lines as (
  select row, count(*) - count(distinct line) as n_dup_lines
  from (select row, unnest(string_split(text, chr(10))) as line from words)
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by row
),
windows as (
  select row, i, array_to_string(w[i:i + 7], ' ') as span
  from (select row, w, unnest(range(1, len(w) - 6)) as i from words where len(w) >= 8)
),
twice as (select row, unnest(list(i)) as i from windows group by row, span having count(*) > 1),
repeats as (select row, count(distinct j) as n_repeat_words from (select row, unnest(range(i, i + 8)) as j from twice) group by row),
counted as (
  select doc_id, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from words left join lines using (row) left join repeats using (row)
),
tested as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
    n_words < 20 or 100 * n_repeat_words > 30 * n_words or n_symbols > 0.1::double * n_words or n_dup_lines * 8 > 0.3::double * n_words as fails
  from counted
),
hosts as (select source, count(*) as n, count(*) filter (fails) as failed from tested group by source),
moments as (select avg(failed / n) as m, greatest(avg((failed / n) * (failed / n)) - avg(failed / n) * avg(failed / n), 1e-9) as v from hosts),
prior as (select m, least(greatest(m * (1 - m) / v - 1, 2.0::double), 1000.0::double) as weight from moments)
select t.doc_id, t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, t.base_failed,
  not t.fails and not (h.failed + p.m * p.weight) / (h.n + p.weight) > 0.8::double as kept
from tested t join hosts h on t.source is not distinct from h.source cross join prior p
"""


@query("op5_quality_rules", SQL)
def quality_rules(spark, folder):
    return judged(read(spark, folder, "documents")).select("doc_id", *COUNTS, "base_failed", "kept")
