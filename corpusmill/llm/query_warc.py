"""op7: all pages written as WARC and read back."""

from __future__ import annotations

from corpusmill.session import scratch_folder

from .common import read
from .registry import query
from .warc import read_archives, write_archives

SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html)::bigint as payload_bytes, sha256(html) as payload_digest from p),
f as (select payload_digest, min(page_id) as first from d where payload_bytes >= 100 group by 1)
select d.page_id, d.payload_bytes, d.payload_digest,
  case when f.first <> d.page_id then 'revisit' else 'response' end as record_type,
  case when f.first <> d.page_id then f.first end as refers_to
from d left join f on d.payload_bytes >= 100 and d.payload_digest = f.payload_digest
"""


@query("op7_warc_archives", SQL)
def warc_archives(spark, folder):
    archives = f"{scratch_folder(spark)}/warc"
    write_archives(read(spark, folder, "pages"), archives)
    return read_archives(spark, archives)
