"""Administrative term replacement and query term expansion, both native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_col, has_non_ascii, let, string_array, strip, tokens

# Variant -> canonical term.
TERMS = {
    "주소록": "연락처목록",
    "과태금": "과태료",
    "주민번호": "주민등록번호",
    "핸드폰": "휴대전화",
    "휴대폰": "휴대전화",
    "첨부서류": "붙임서류",
    "시행일": "시행일자",
    "접수일": "접수일자",
    "공문": "공문서",
    "기안지": "기안문",
    "거래처": "협력기관",
    "전자메일": "이메일",
}
QUERY_TERM_LIMIT = 24


def _whole_word(term: str) -> str:
    return rf"(?<![\p{{L}}\p{{N}}_]){term}(?![\p{{L}}\p{{N}}_])"


def _replacing(variant: str, canonical: str) -> Callable[[Column], Column]:
    return lambda text: F.when(F.contains(text, F.lit(variant)), F.regexp_replace(text, _whole_word(variant), canonical)).otherwise(text)


def replace_terms(value: Column | str) -> Column:
    """Whole-word replacement; a pattern runs over a text only where the text holds its variant."""
    value = as_col(value)
    replaced = value
    for variant, canonical in TERMS.items():
        replaced = let(replaced, _replacing(variant, canonical))
    return F.when(has_non_ascii(value), replaced).otherwise(value)


def term_counts(value: Column | str) -> Column:
    """Map "variant -> canonical" to its count.

    No canonical form is itself a variant, so counts on the input equal counts taken while
    replacing one term after the other.
    """
    value = as_col(value)
    keys = string_array([f"{variant} -> {canonical}" for variant, canonical in TERMS.items()])
    counts = F.array(*[F.when(F.contains(value, F.lit(v)), F.regexp_count(value, F.lit(_whole_word(v)))).otherwise(0) for v in TERMS])
    empty = F.create_map().cast("map<string,int>")
    found = F.map_filter(F.map_from_arrays(keys, counts), lambda _k, n: n > 0)
    return F.when(has_non_ascii(value), found).otherwise(empty)


def _expansions() -> dict[str, list[str]]:
    linked: dict[str, set[str]] = {}
    for variant, canonical in TERMS.items():
        linked.setdefault(variant, set()).add(canonical)
        linked.setdefault(canonical, set()).add(variant)
    return {term: sorted(others) for term, others in linked.items()}


def expand_query_tokens(token_array: Column, limit: int | None = None) -> Column:
    """Tokens with their linked terms, first occurrence kept; all of them, or the first ``limit``."""
    pairs = []
    for term, others in _expansions().items():
        pairs += [F.lit(term), string_array(others)]
    links = F.create_map(*pairs)
    empty = F.array().cast("array<string>")
    spread = F.transform(
        token_array, lambda t: F.concat(F.array(t), F.coalesce(F.try_element_at(links, t), empty))
    )
    expanded = F.array_distinct(F.flatten(spread))
    return F.slice(expanded, 1, limit) if limit else expanded


def normalize_query(value: Column | str, limit: int | None = None) -> Column:
    """The question as its expanded tokens, all of them or the first ``limit``."""
    value = as_col(value)
    found = tokens(value)
    return F.when(F.size(found) == 0, strip(value)).otherwise(
        F.array_join(expand_query_tokens(found, limit), " ")
    )
