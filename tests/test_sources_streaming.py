"""File formats, readers, sinks, whole plans and streams."""

import io
import json
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from corpusmill.config import Settings
from corpusmill.plans import ingest
from corpusmill.sources import files, formats, sinks
from corpusmill.streaming import cache, guarded, intake


def hwpx():
    xml = """<s:sec xmlns:s="urn:s" xmlns:p="urn:p"><p:p><p:run><p:t>식품의약품안전처 고시 제2026-1호</p:t></p:run></p:p><p:p><p:run><p:t>1. 추진 배경</p:t></p:run></p:p>
    <p:tbl><p:tr><p:tc><p:p><p:t>구분</p:t></p:p></p:tc><p:tc><p:p><p:t>처분기준</p:t></p:p></p:tc></p:tr>
    <p:tr><p:tc><p:p><p:t>1차 위반</p:t></p:p></p:tc><p:tc><p:p><p:t>영업정지 7일</p:t></p:p></p:tc></p:tr></p:tbl></s:sec>"""
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        archive.writestr("Contents/section0.xml", xml)
    return data.getvalue()


def png(width, height):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IEND", b"")


def docx():
    xml = ('<w:document xmlns:w="urn:w"><w:body><w:p><w:r><w:t>본문</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>가</w:t></w:r></w:p></w:tc>'
           '<w:tc><w:p><w:r><w:t>나</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        archive.writestr("word/document.xml", xml)
    return data.getvalue()


def xlsx():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        archive.writestr("xl/workbook.xml", '<workbook xmlns:r="urn:r"><sheets><sheet name="표" r:id="r1"/></sheets></workbook>')
        archive.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        archive.writestr("xl/sharedStrings.xml", "<sst><si><t>학교</t></si></sst>")
        archive.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row></sheetData></worksheet>')
    return data.getvalue()


def test_formats(spark):
    rows = [
        ("a.hwpx", hwpx()), ("b.png", png(120, 80)), ("c.docx", docx()), ("d.xlsx", xlsx()), ("e.csv", "이름,값\n\n 가 ,1\n나\n".encode("cp949")),
        ("f.html", b"<p>a<script>x</script>b</p><li>c"), ("g.json", b'{"k":[1]}'), ("h.txt", "글".encode("utf-16")), ("i.pdf", b"%PDF"), ("j.docx", b"nozip"),
    ]
    df = spark.createDataFrame([(n, bytearray(p)) for n, p in rows], "name string, payload binary")
    out = {r["name"]: r["parsed"] for r in files.parse_documents(df).collect()}
    assert out["a.hwpx"]["mime_type"] == "application/hwp+zip"
    assert out["a.hwpx"]["text"].split("\n\n") == ["식품의약품안전처 고시 제2026-1호", "1. 추진 배경", "| 구분 | 처분기준 |", "| 1차 위반 | 영업정지 7일 |"]
    assert out["b.png"]["metadata"]["width"] == "120" and "b.png" in out["b.png"]["text"]
    assert out["c.docx"]["text"] == "본문\n| 가 | 나 |\n| --- | --- |"
    assert out["d.xlsx"]["text"] == "[시트: 표]\n| 학교 |  | 5 |\n| --- | --- | --- |"
    assert out["e.csv"]["text"] == "| 이름 | 값 |\n| --- | --- |\n| 가 | 1 |\n| 나 |  |"
    assert out["f.html"]["text"] == "ab\n\nc" and out["g.json"]["text"] == '{\n  "k": [\n    1\n  ]\n}'
    assert out["i.pdf"]["error"] and out["j.docx"]["error"]
    assert out["a.hwpx"]["metadata"]["extraction_status"] == "success"


def test_archive_limits(monkeypatch):
    monkeypatch.setattr(formats, "MAX_MEMBERS", 0)
    with pytest.raises(formats.ParseError):
        formats.parse_document("x.hwpx", hwpx())


def test_hwp_section_records():
    body = "문단".encode("utf-16le")
    stream = struct.pack("<I", 67 | len(body) << 20) + body + struct.pack("<I", 66 | 2 << 20) + b"zz"
    assert formats.hwp_section_text(stream) == "문단"


def test_markdown_tables(spark):
    text = "| a | b |\n|---|:---:|\n| 1 | 2 |\n\n| x |\n\n| p | q |\n| only |\n| c |\n| d\\|e |"
    df = spark.createDataFrame([(1, text)], "k int, t string")
    rows = [(r["table_index"], r["row_index"], r["cells"]) for r in files.markdown_tables(df, "k", "t").collect()]
    assert rows == [(0, 0, ["a", "b"]), (0, 1, ["1", "2"])]


def test_delimited_and_golden(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,"x, y"\n,\n2,z\n', encoding="utf-8")
    assert [tuple(r) for r in files.read_delimited(spark, str(tmp_path / "t.csv")).collect()] == [("1", "x, y"), ("2", "z")]
    with pytest.raises(ValueError):
        files.check_header(["a", "A"])
    golden = [{"query": "q", "ground_truth": "t"}, {"query": " "}, {"query": "q", "evaluate_answer": False, "expected_guardrail_action": "stop"}]
    (tmp_path / "g.jsonl").write_text("\n".join(map(json.dumps, golden)), encoding="utf-8")
    assert [r["valid"] for r in files.read_golden(spark, str(tmp_path / "g.jsonl")).collect()] == [True, False, False]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("q", "a")], "input string, output string")
    sinks.export_curated(df, str(tmp_path / "s"))
    assert files.read_samples(spark, str(tmp_path / "s")).columns == ["input", "instruction", "output"]
    sinks.append_traces(df, str(tmp_path / "t"))
    sinks.append_traces(df, str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).count() == 2


def test_ingest_is_idempotent(spark):
    docs = spark.createDataFrame([(1, "a", "p", "같은 글 " * 50), (2, "a", "p", "같은 글 " * 50), (3, "b", "p", " \n "), (4, "b", "p", "연락처 010-1234-5678 입니다")],
                                 "document_id int, source_name string, project_name string, text string")
    stored, chunks = ingest.ingest(docs, Settings(parent_child_chunking=True, contextual_retrieval=True), dim=8)
    kept = {r["document_id"]: r["content"] for r in stored.collect()}
    assert sorted(kept) == [1, 4] and "010-****-5678" in kept[4]
    assert {r["document_id"] for r in chunks.collect()} == {1, 4} and all(len(r["embedding"]) == 8 for r in chunks.collect())
    assert ingest.ingest(docs, dim=8, stored=stored)[0].count() == 0


def test_intake_takes_each_file_once(spark, tmp_path):
    box, store, mark = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "mark")
    box.mkdir()
    (box / "a.txt").write_text("첫 문서 내용", encoding="utf-8")
    (box / "skip.exe").write_text("no", encoding="utf-8")
    run = lambda: intake.watch(spark, str(box), store, mark, dim=8, once=True).awaitTermination()
    run()
    (box / "b.html").write_text("<p>둘째</p>", encoding="utf-8")
    run()
    run()
    assert sorted(r["source_name"] for r in spark.read.parquet(store + "/documents").collect()) == ["a.txt", "b.html"]
    assert spark.read.parquet(store + "/chunks").count() == 2


def released(tokens, context="서울 수도 전화 안내 문장"):
    trace = guarded.Trace(context=context)
    guard = guarded.Guard("t", trace)
    for token in tokens:
        guard.take(token)
    guard.finish()
    events = [(kind, json.loads(payload)) for _t, _n, kind, payload in guard.out]
    return "".join(p["content"] for k, p in events if k == "token"), events


def test_guarded_stream_masks_split_numbers():
    text, events = released(["전화 안내는 010", "-1234", "-56", "78 입니다. ", "서울 안내 문장 끝"], context="서울 전화 안내는 입니다 문장")
    assert "010-****-5678" in text and "1234" not in text
    assert [p for k, p in events if p.get("phase") == "final"][0]["action"] == "mask" and events[-1][0] == "done"


def test_guarded_stream_holds_cut_inside_a_match():
    text, _events = released(["가나다 " * 150, "01012345678", " 끝"], context="가나다 끝")
    assert "010-****-5678" in text


def test_guarded_stream_stops_unsupported_text():
    text, events = released(["프랑스의 수도는 파리이며 에펠탑은 높습니다. ", "더 많은 말"])
    assert text == guarded.REFUSAL
    assert [p for k, p in events if p.get("phase") == "final"][0]["action"] == "block"


def test_guarded_stream_job_orders_tokens(spark, tmp_path):
    rows = [("t", 2, "셋.", True, None), ("t", 0, "하나 ", False, "하나 둘 셋"), ("t", 1, "둘 ", False, None)]
    spark.createDataFrame(rows, guarded.TOKEN_SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(guarded.TOKEN_SCHEMA).parquet(str(tmp_path / "in"))
    query = guarded.guard_tokens(stream).writeStream.format("memory").queryName("released").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    events = spark.table("released").orderBy("event").collect()
    assert "".join(json.loads(e["payload"])["content"] for e in events if e["type"] == "token") == "하나 둘 셋."


def test_cache_stream(spark, tmp_path):
    rows = [("k", 1, 0.0, [1.0, 0.0], "old"), ("k", 2, 1.0, [1.0, 0.01], "new"), ("k", 3, 2.0, [1.0, 0.0], None), ("k", 4, 2.0, [0.0, 1.0], None),
            ("k", 5, 5000.0, [1.0, 0.0], None), ("j", 6, 2.0, [1.0, 0.0], None)]
    spark.createDataFrame(rows, cache.REQUEST_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(cache.REQUEST_SCHEMA).parquet(str(tmp_path / "in"))
    query = cache.cached_answers(stream).writeStream.format("memory").queryName("cached").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    got = {r["request_id"]: r["response"] for r in spark.table("cached").collect()}
    assert got == {3: "new", 4: None, 5: None, 6: None}


def test_registry(spark, sf):
    from queryset import ORACLES, QUERIES

    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 120
    assert QUERIES["AGG-06_grouped_sum"](spark, sf).count() == 3
