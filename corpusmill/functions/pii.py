"""Personal-data candidates: detection, greedy choice of spans and masking."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import as_col

# Categories in priority order with their patterns.
PATTERNS = {
    "주민등록번호": r"(?<!\d)(\d{6})[- ]?([1-4]\d{6})(?!\d)",
    "외국인등록번호": r"(?<!\d)(\d{6})[- ]?([5-8]\d{6})(?!\d)",
    "휴대전화번호": r"(?<!\d)(01[016789])[- .]?(\d{3,4})[- .]?(\d{4})(?!\d)",
    "일반전화번호": r"(?<!\d)(0[2-6][1-5]?)[- .]?(\d{3,4})[- .]?(\d{4})(?!\d)",
    "이메일주소": r"(?<![a-zA-Z0-9_.+-])([a-zA-Z0-9_.+-]+)@([a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+)(?![a-zA-Z0-9.-])",
    "신용카드번호": r"(?<!\d)(\d{4})[- ]?(\d{4})[- ]?(\d{4})[- ]?(\d{4})(?!\d)",
    "계좌번호": r"(?<!\d)(\d{3,6})[- ](\d{2,6})[- ](\d{3,6})(?!\d)",
}
CATEGORIES = list(PATTERNS)
# Every pattern needs an "@" or three digits in a row; other text skips Python.
_CANDIDATE = r"@|\p{Nd}{3}"
_COMPILED = [(name, re.compile(pattern)) for name, pattern in PATTERNS.items()]

SPAN_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("category", T.StringType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
        ]
    )
)
RESULT_TYPE = T.StructType([T.StructField("masked", T.StringType()), T.StructField("spans", SPAN_TYPE)])


def _mask(category: str, groups: tuple[str, ...]) -> str:
    # The visible part of each category.
    first, last = groups[0], groups[-1]
    if category in ("주민등록번호", "외국인등록번호"):
        return f"{first}-{last[0]}******"
    if category in ("휴대전화번호", "일반전화번호"):
        return f"{first}-****-{last}"
    if category == "이메일주소":
        shown = first[:2] if len(first) > 2 else first[0]
        return f"{shown}***@{last}"
    if category == "신용카드번호":
        return f"{first}-****-****-{last}"
    return f"{first}-****-**{last[-2:]}"


def find_spans(text: str) -> list[tuple[int, int, str, str]]:
    """Non-overlapping (start, end, category, replacement): earliest start, then priority."""
    found = []
    for order, (category, pattern) in enumerate(_COMPILED):
        for hit in pattern.finditer(text):
            found.append((hit.start(), order, -hit.end(), category, hit.groups()))
    chosen: list[tuple[int, int, str, str]] = []
    free_from = 0
    for start, _order, negative_end, category, groups in sorted(found, key=lambda f: f[:3]):
        if start >= free_from:
            free_from = -negative_end
            chosen.append((start, free_from, category, _mask(category, groups)))
    return chosen


def mask_spans(text: str, spans: list[tuple[int, int, str, str]]) -> str:
    pieces, position = [], 0
    for start, end, _category, replacement in spans:
        pieces += [text[position:start], replacement]
        position = end
    pieces.append(text[position:])
    return "".join(pieces)


@F.pandas_udf(RESULT_TYPE)
def _scan(values: pd.Series) -> pd.DataFrame:
    masked, spans = [], []
    for text in values:
        if text is None:
            masked.append(None)
            spans.append(None)
            continue
        found = find_spans(text)
        masked.append(mask_spans(text, found) if found else None)
        spans.append([{"category": c, "start": s, "end": e} for s, e, c, _r in found])
    return pd.DataFrame({"masked": masked, "spans": spans})


def scan_pii(value: Column | str) -> Column:
    """STRUCT(masked, spans); null fields mean nothing was found.

    Use once per row and read both fields from it through ``masked_text`` and ``pii_spans``.
    """
    value = as_col(value)
    return _scan(F.when(value.rlike(_CANDIDATE), value))


def masked_text(scan: Column, original: Column | str) -> Column:
    return F.coalesce(scan["masked"], as_col(original))


def pii_spans(scan: Column) -> Column:
    return F.coalesce(scan["spans"], F.array().cast(SPAN_TYPE))


def mask_pii(value: Column | str) -> Column:
    return masked_text(scan_pii(value), value)
