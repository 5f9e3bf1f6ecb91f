"""op10: the mix of all documents by source."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import read
from .mixing import copy_counts
from .registry import query

SQL = r"""
with recursive sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents
),
sources as (
  select source, sum(size)::bigint as source_size,
    [5, 2, 1][((row_number() over (order by encode(source) nulls last) - 1) % 3 + 1)::int] as weight
  from sized group by source
),
totals as (select sum(source_size)::bigint as total, sum(weight)::bigint as weights from sources),
levels as (
  select 0 as round, total::double / weights as level, 0::bigint as held from totals
  union all
  select l.round + 1,
    (select (t.total - sum(case when s.weight * l.level >= s.source_size * 3 then s.source_size * 3 else 0 end))::double
      / sum(case when s.weight * l.level >= s.source_size * 3 then 0 else s.weight end) from sources s, totals t group by t.total),
    (select count(*) from sources s where s.weight * l.level >= s.source_size * 3)
  from levels l
  where l.round < 100 and (select count(*) from sources s where s.weight * l.level >= s.source_size * 3) between l.held + 1 and (select count(*) - 1 from sources)
),
final as (select level from levels order by round desc limit 1),
rates as (
  select source, source_size, least(weight * level, (source_size * 3)::double) as target,
    case when source_size > 0 then least(least(weight * level, (source_size * 3)::double) / source_size, 3.0) else 0.0 end as rate
  from sources, final
)
select d.doc_id, d.size, r.source_size, r.target,
  d.size * (floor(rate)::bigint + case when
    ('0x' || substr(md5('mix:' || coalesce(d.doc_id::varchar, '')), 1, 13))::bigint::double / 4503599627370496.0 < rate - floor(rate) then 1 else 0 end) as taken
from sized d join rates r on d.source is not distinct from r.source
"""


@query("op10_mix_sources", SQL)
def mix_sources(spark, folder):
    counts = copy_counts(read(spark, folder, "documents"))
    return counts.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
