"""Text normalization, lines, tokens and small text measures as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_TEXT_CHARACTERS = 5_000_000

# What str.strip() and str.splitlines() treat as white space and line ends.
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0       "
    "         　"
)
SPACE_CLASS = r"\s\x1c-\x1f\x85\p{Z}"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
# Characters outside this closed set may change under NFKC; text inside it never does.
NOT_PLAIN_LATIN = r"[^\x00-\x7FÀ-ÖØ-öø-ÿ]"
NFKC_UNSTABLE = r"[^\x00-\x7FÀ-ÖØ-öø-ÿ\x{0400}-\x{045F}가-힣\x{4E00}-\x{9FA5}]"

# Keyword token pattern and stop words.
TOKEN_PATTERN = "[가-힣]{2,}|[a-zA-Z][a-zA-Z0-9_-]*|[0-9]+"
TOKEN_STOPWORDS = [
    "관련", "기준", "내용", "방법", "사항", "자료", "정보", "정도", "경우", "대해", "대한",
    "그리고", "또는", "어떻게", "무엇", "어디", "언제", "해주세요", "알려주세요",
]
# Evaluation keyword pattern and stop words.
KEYWORD_PATTERN = "[가-힣a-zA-Z0-9]{2,}"
KEYWORD_STOPWORDS = [
    "있는", "없는", "대한", "관한", "위한", "통해", "따른", "있음", "없음",
    "그리고", "그러나", "따라서", "등에", "것으로", "하는", "이다", "합니다",
    "this", "that", "with", "from", "have", "been", "were", "what", "which",
]
# Utterances answered without retrieval, and their three replies.
GREETINGS = [
    "안녕", "안녕하세요", "안녕하십니까", "반가워요", "반갑습니다", "고마워",
    "고마워요", "감사합니다", "수고하세요", "너누구야", "너는누구니",
]
REPLY_THANKS = "천만에요. 문서 검색이나 품질 진단이 필요하면 말씀해 주세요."
REPLY_WHO = "저는 사내 문서 검색과 비정형 데이터 품질 진단을 돕는 AI입니다."
REPLY_HELLO = "안녕하세요. 사내 문서 검색과 품질 진단을 도와드릴게요."


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def string_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def has_non_ascii(value: Column | str) -> Column:
    """More bytes than characters; no pattern is run."""
    value = as_col(value)
    return F.octet_length(value) != F.length(value)


def nfkc(value: Column | str) -> Column:
    """NFKC; only text holding a character that can change goes through Python."""
    value = as_col(value)
    # From the cheapest test to the dearest: pure ASCII, plain Latin letters, the whole set.
    unstable = has_non_ascii(value) & value.rlike(NOT_PLAIN_LATIN) & value.rlike(NFKC_UNSTABLE)
    return F.coalesce(_nfkc(F.when(unstable, value)), value)


def strip(value: Column | str) -> Column:
    return F.btrim(as_col(value), F.lit(WHITESPACE))


def rounded(value: Column | str, digits: int) -> Column:
    """The double nearest to the decimal rounding of the exact binary value, ties to even.

    Built-in rounding works on the shortest decimal form, which turns values just beside a
    tie into ties. Here the distance to the tie is computed without error: the value is split
    into two halves whose products with the small scale are exact.
    """
    if isinstance(value, str):
        return _rounded(F.col(value).cast("double"), digits)
    return let(value.cast("double"), lambda v: _rounded(v, digits))


def _rounded(v: Column, digits: int) -> Column:
    scale = float(10**digits)
    below = F.floor(v * scale)
    high = v * 134217729.0 - (v * 134217729.0 - v)
    beyond = (high * (2 * scale) - (below * 2 + 1).cast("double")) + (v - high) * (2 * scale)
    up = (beyond > 0) | ((beyond == 0) & (F.pmod(below, F.lit(2)) == 1))
    exact = (below + F.when(up, 1).otherwise(0)).cast("double") / scale
    return F.when(F.abs(v) < 2.0**31, exact).otherwise(F.bround(v, digits))


def clean_whitespace(value: Column | str) -> Column:
    value = F.replace(as_col(value), F.lit("\x00"), F.lit(""))
    value = F.regexp_replace(value, r"\r\n?", "\n")
    value = F.regexp_replace(value, r"[ \t]+\n", "\n")
    value = F.regexp_replace(value, r"\n{3,}", "\n\n")
    return strip(value)


def normalize_text(value: Column | str) -> Column:
    return clean_whitespace(nfkc(value))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``.

    A plain column expression inside a higher-order lambda is evaluated again for every
    element; a lambda variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def lines(value: Column | str) -> Column:
    """Lines without their ends; a final line end opens no extra line."""

    def drop_tail(parts: Column) -> Column:
        return F.when(
            F.element_at(parts, -1) == "",
            F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))),
        ).otherwise(parts)

    return let(F.split(as_col(value), LINE_BREAK, -1), drop_tail)


def non_empty_lines(line_array: Column) -> Column:
    return F.filter(F.transform(line_array, strip), lambda line: line != "")


def content_hash(normalized: Column | str) -> Column:
    return F.sha2(as_col(normalized).cast("binary"), 256)


def tokens(value: Column | str) -> Column:
    """Lower-case keyword tokens of two or more characters, repeats kept."""
    stop = string_array(TOKEN_STOPWORDS)
    found = F.regexp_extract_all(F.lower(as_col(value)), F.lit(TOKEN_PATTERN), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t))


def keyword_set(value: Column | str) -> Column:
    found = F.regexp_extract_all(F.lower(as_col(value)), F.lit(KEYWORD_PATTERN), F.lit(0))
    return F.array_except(found, string_array(KEYWORD_STOPWORDS))


def plain_token_set(value: Column | str) -> Column:
    found = F.regexp_extract_all(as_col(value), F.lit(KEYWORD_PATTERN), F.lit(0))
    return F.array_distinct(F.transform(found, F.lower))


def normalize_phrase(value: Column | str) -> Column:
    words = F.regexp_extract_all(F.lower(nfkc(value)), F.lit("[가-힣]+|[a-z0-9]+"), F.lit(0))
    return F.array_join(words, " ")


def sentences_after_stop(value: Column | str) -> Column:
    """Sentences cut at a stop mark and white space; the mark is dropped; over 10 characters."""
    parts = F.transform(F.split(as_col(value), rf"[.?!][{SPACE_CLASS}]+", -1), strip)
    return F.filter(parts, lambda s: F.length(s) > 10)


def sentences_for_scoring(value: Column | str) -> Column:
    """Sentences for grounding: cut after stop marks; over 5 characters; else the whole text."""
    value = as_col(value)
    parts = F.transform(
        F.split(value, rf"[.?!]\n|(?<=[.?!])[{SPACE_CLASS}]+", -1), strip
    )
    kept = F.filter(parts, lambda s: F.length(s) > 5)
    whole = strip(value)
    return F.when((F.size(kept) == 0) & (whole != ""), F.array(whole)).otherwise(kept)


def token_estimate(value: Column | str) -> Column:
    return F.floor(F.length(as_col(value)) / 3).cast("int")


def citations(value: Column | str) -> Column:
    # A number too long for 64 bits can name no hit.
    found = F.regexp_extract_all(as_col(value), F.lit(r"\[([0-9]+)\]"), F.lit(1))
    return F.transform(found, lambda n: F.coalesce(n.try_cast("bigint"), F.lit(2**62)))


def query_route(value: Column | str) -> Column:
    bare = F.lower(F.regexp_replace(as_col(value), rf"[{SPACE_CLASS}.!?,~。！？]+", ""))
    return F.when(bare.isin(GREETINGS), "conversation").otherwise("retrieval")


def conversational_reply(value: Column | str) -> Column:
    bare = F.regexp_replace(as_col(value), rf"[{SPACE_CLASS}]+", "")
    return (
        F.when(bare.contains("고마") | bare.contains("감사"), REPLY_THANKS)
        .when(bare.contains("누구"), REPLY_WHO)
        .otherwise(REPLY_HELLO)
    )


def wants_hyde(value: Column | str) -> Column:
    value = as_col(value)
    return (F.size(tokens(value)) <= 3) & (F.length(value) <= 80)


def valid_calendar_date(value: Column | str) -> Column:
    value = as_col(value)
    shaped = value.rlike(r"^\d{4}([-/.])\d{2}\1\d{2}\z")
    parsed = F.translate(value, "/.", "--").try_cast("date")
    return shaped & parsed.isNotNull() & (F.substring(value, 1, 4) != "0000")


def data_uri(payload: Column | str, mime: Column | str = "image/png") -> Column:
    mime = F.lit(mime) if isinstance(mime, str) else mime
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(as_col(payload)), r"\s", ""))


def first_json_object(value: Column | str) -> Column:
    """Text of the first balanced JSON object in a model answer, code fences removed; else null."""
    bare = F.regexp_replace(strip(value), r"^```[a-zA-Z]*\s*|\s*```$", "")
    start = F.instr(bare, "{")
    return F.when(start > 0, _json_prefix(F.substr(bare, start)))


@F.pandas_udf(T.StringType())
def _json_prefix(values: pd.Series) -> pd.Series:
    import json

    decoder = json.JSONDecoder()

    def cut(text: str) -> str | None:
        try:
            value, end = decoder.raw_decode(text)
        except ValueError:
            return None
        return text[:end] if isinstance(value, dict) else None

    return values.map(cut, na_action="ignore")
