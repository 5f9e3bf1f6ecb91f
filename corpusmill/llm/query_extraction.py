"""op3: the main text of all pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import read
from .extraction import extract
from .registry import query


@query("op3_extract_pages")
def extract_pages(spark, folder):
    pages = read(spark, folder, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
