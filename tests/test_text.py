"""Column functions against hand-worked values and plain Python."""

import hashlib
import random
import re
import unicodedata

from pyspark.sql import functions as F

from corpusmill.functions import chunking, context, pii, terms, text, vectors


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("r")).first()["r"]


def test_rounding_equals_python(spark):
    random.seed(3)
    values = [round(random.uniform(-90, 90), random.choice([1, 2, 3, 4, 5])) for _ in range(5000)] + [k / 8 for k in range(-50, 50)] + [0.155, 2.675]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (1, 2, 3, 4):
        for row in df.select("v", text.rounded("v", digits).alias("r")).collect():
            assert row["r"] == round(row["v"], digits)


def test_normalize_matches_python(spark):
    samples = ["ﬁle Ｎo.１ \t\r\n\r\n\r\n\r\nx\x00y\rz  ", "  앞뒤 공백　", "", "é é", "a ", "㈜한국", "plain"]
    for sample in samples:
        assert one(spark, text.normalize_text, sample) == chunking.normalize(sample), repr(sample)


def test_lines_match_splitlines(spark):
    for sample in ["a\nb", "a\n", "", "\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x85g h ", "a\n\nb\n"]:
        assert one(spark, text.lines, sample) == sample.splitlines(), repr(sample)


def test_tokens_and_query_expansion(spark):
    assert one(spark, text.tokens, "식품위생 행정처분 기준 GPU-2 7 42") == ["식품위생", "행정처분", "gpu-2", "42"]
    assert one(spark, terms.normalize_query, "핸드폰 핸드폰 번호") == "핸드폰 휴대전화 번호"
    assert one(spark, terms.normalize_query, "휴대전화") == "휴대전화 핸드폰 휴대폰"
    assert one(spark, terms.normalize_query, " ? ") == "?"


def test_terms_replace_whole_words_only(spark):
    sample = "과태금과 주소록 확인"
    assert one(spark, terms.replace_terms, sample) == "과태금과 연락처목록 확인"
    assert one(spark, terms.term_counts, sample) == {"주소록 -> 연락처목록": 1}


def test_pii_masks(spark):
    sample = "담당자 홍길동 (주민번호: 900101-1234567, 휴대폰: 010-9876-5432) a@b.kr abc@d.com 1234-5678-9012-3456 123-45-678901 02-345-6789"
    masked = one(spark, pii.mask_pii, sample)
    for part in ("900101-1******", "010-****-5432", "a***@b.kr", "ab***@d.com", "1234-****-****-3456", "123-****-**01", "02-****-6789"):
        assert part in masked
    row = spark.createDataFrame([(sample,), ("no data",)], "v string").select(pii.pii_spans(pii.scan_pii("v")).alias("s")).collect()
    assert len(row[0]["s"]) == 7 and row[1]["s"] == []
    assert [sample[s["start"] : s["end"]] for s in row[0]["s"]][0] == "900101-1234567"
    assert one(spark, pii.mask_pii, masked) == masked


def test_pii_greedy_matches_position_by_position():
    """Earliest start wins, then priority; later overlapping candidates are skipped."""
    random.seed(5)
    for _ in range(300):
        sample = "".join(random.choice("0123456789- @ab.") for _ in range(60))
        spans = pii.find_spans(sample)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        candidates = [(m.start(), i, m.end(), c) for i, (c, p) in enumerate(pii.PATTERNS.items()) for m in re.finditer(p, sample)]
        free, expected = 0, []
        while left := [c for c in candidates if c[0] >= free]:
            start, _order, free, category = min(left)
            expected.append((start, free, category))
        assert [(s, e, c) for s, e, c, _r in spans] == expected


def test_hash_embedding(spark):
    token = spark.createDataFrame([("abc",)], "v string").select(vectors.hash_bucket(F.col("v"), 64).alias("r")).first()["r"]
    assert token == 42 == int.from_bytes(hashlib.sha256(b"abc").digest()[:8], "big") % 64
    vector = one(spark, lambda c: vectors.hash_embedding(c, 64), "abc ABC é")
    assert abs(sum(x * x for x in vector) - 1) < 1e-9 and vector[42] == max(vector)
    assert one(spark, lambda c: vectors.hash_embedding(c, 8), "") is not None


def test_chunks_cover_and_slice_back():
    random.seed(7)
    for _ in range(60):
        words = [random.choice(["단어", "word", "문장입니다.", "끝!", "\n", "\n\n", "| a | b |\n", "1. 제목\n", "제3조(목적)\n"]) for _ in range(300)]
        source = " ".join(words)
        normal = chunking.normalize(source)
        parts = chunking.split_text(source, 120, 30)
        assert all(normal[a:b] == piece for piece, a, b in parts)
        assert parts[0][1] == 0 and parts[-1][2] == len(normal)
        assert all(not normal[x[2] : y[1]].strip() for x, y in zip(parts, parts[1:]))
        assert all(b - a <= 120 * 1.2 for _p, a, b in parts)


def test_parent_child_offsets(spark):
    source = "첫 문단입니다. " * 200
    rows = spark.createDataFrame([(source,)], "v string").select(F.inline(chunking.parent_child_array("v"))).collect()
    normal = chunking.normalize(source)
    assert [r["chunk_index"] for r in rows] == list(range(len(rows)))
    assert all(normal[r["char_start"] : r["char_end"]] == r["text"] and r["text"] in r["parent_text"] for r in rows)


def test_chunk_header():
    source = "# 제목\n본문\n## 소제목\n" + "내용 문장. " * 60
    assert chunking.split_text(source, 100, 10, header=True)[-1][0].startswith("[문맥: ## 소제목]\n")


def test_context_prefix_keeps_limits(spark):
    df = spark.createDataFrame([("t" * 500, "p" * 500, "s" * 900)], "t string, p string, s string")
    prefix = df.select(context.context_prefix(F.col("t"), F.col("p"), F.col("s")).alias("r")).first()["r"]
    assert len(prefix) <= 768 and prefix.split("\n")[0] == "문서 제목: " + "t" * 120


def test_dates_routes_and_json(spark):
    for value, good in [("2024-02-29", True), ("2023-02-29", False), ("2024-01/02", False), ("2024.12.31", True), ("24-01-01", False)]:
        assert one(spark, text.valid_calendar_date, value) is good
    assert one(spark, text.query_route, "안녕하세요!!") == "conversation"
    assert one(spark, text.query_route, "안녕하세요 문서 찾아줘") == "retrieval"
    assert one(spark, text.first_json_object, '```json\n{"a": {"b": 1}} tail\n```') == '{"a": {"b": 1}}'
    assert one(spark, text.first_json_object, "none") is None
    assert one(spark, text.normalize_phrase, "Ｇ마켓, ABC") == unicodedata.normalize("NFKC", "g 마켓 abc")


def test_model_embedding_checks_length(spark):
    df = spark.createDataFrame([("ab",), ("c",)], "v string")
    load = lambda: lambda texts: [[len(t), 0.0] for t in texts]
    assert [r[0] for r in df.select(vectors.model_embedding("v", load, 2)).collect()] == [[1.0, 0.0], [1.0, 0.0]]
    import pytest

    with pytest.raises(Exception, match="another length"):
        df.select(vectors.model_embedding("v", load, 3)).collect()
