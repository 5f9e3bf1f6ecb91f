"""Text functions, text quality, personal data, parsing and chunking over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.text import rounded
from corpusmill.functions import chunking, context, pii, terms, text, vectors
from corpusmill.operators import catalog, compare, quality
from corpusmill.plans import ingest
from corpusmill.session import fan_out
from corpusmill.sources import files
from corpusmill.sources.tables import documents, table

from .common import Registry, SQL_SPACE, by_id, quoted, sql_chunks, sql_strip, sql_tokens

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

NORMAL = sql_strip(
    r"regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')")
DOCS = f"select doc_id, source, lang, text, {NORMAL} as norm from documents"
MEASURES = rf"""
lines as (select *, case when norm = '' then [] else string_split(norm, chr(10)) end as ls from ({DOCS})),
kept as (select *, list_filter(list_transform(ls, lambda x: trim(x, {SQL_SPACE})), lambda x: x <> '') as ne from lines),
m as (select doc_id, source, norm, length(norm) as char_count, len(ls) as line_count, len(ne) as non_empty_line_count,
  len(regexp_extract_all(norm, '[^\s]+')) as word_count, length(norm) - length(replace(norm, '�', '')) as replacement_count,
  len(regexp_extract_all(norm, '[\x00-\x08\x0b-\x1f]')) as control_count,
  case when len(ls) = 0 then 0.0 else (len(ls) - len(ne)) / len(ls) end as blank_ratio,
  case when len(ne) = 0 then 0.0 else (len(ne) - len(list_distinct(ne))) / len(ne) end as dup_ratio from kept)"""


@R.add("TXT-01_normalize", f"select doc_id, sha256(norm) as normal_hash, length(norm) as n from ({DOCS})")
def normalize(spark, folder):
    return documents(spark, folder).select("document_id", text.normalize_text("text").alias("n")).select(
        F.col("document_id").alias("doc_id"), text.content_hash("n").alias("normal_hash"), F.length("n").alias("n"))


@R.add("TXT-06_tokens", f"""
with t as (select doc_id, unnest({sql_tokens('text')}) as term from documents)
select term, count(*) as uses, count(distinct doc_id) as docs from t group by term""")
def token_counts(spark, folder):
    found = documents(spark, folder).select("document_id", F.explode(text.tokens("text")).alias("term"))
    per_document = found.groupBy("document_id", "term").agg(F.count(F.lit(1)).alias("n"))
    return per_document.groupBy("term").agg(F.sum("n").alias("uses"), F.count(F.lit(1)).alias("docs"))


@R.add("TXT-07_normalized_query", f"""
with t as (select item_id, text, list_filter({sql_tokens('text')}, lambda x: true) as ts from benchmark),
u as (select item_id, text, list_filter(list_transform(range(1, len(ts) + 1), lambda i: case when list_position(ts, ts[i]) = i then ts[i] end), lambda x: x is not null) as ds from t)
select item_id, case when len(ds) = 0 then trim(text) else array_to_string(ds[1:24], ' ') end as normalized from u""")
def normalized_query(spark, folder):
    return table(spark, folder, "benchmark").select("item_id", terms.normalize_query("text", terms.QUERY_TERM_LIMIT).alias("normalized"))


SAID, SAID_SQL = by_id("turn", ["", "안녕하세요!", "Hello ?", "고마워요 감사합니다", "안녕 예산은?"])


@R.add("TXT-08_route", f"""
with c as (select conv_id, turn, case when {SAID_SQL} = '' then text else {SAID_SQL} end as said from conversations)
select conv_id, turn, case when list_contains({quoted(text.GREETINGS)}, lower(regexp_replace(said, '[\\s.!?,~。！？]+', '', 'g'))) then 'conversation' else 'retrieval' end as route from c""")
def route(spark, folder):
    said = F.when(SAID() == "", F.col("text")).otherwise(SAID())
    return table(spark, folder, "conversations").select("conv_id", "turn", text.query_route(said).alias("route"))


@R.add("TXT-09_hyde_trigger", f"select conv_id, turn, len({sql_tokens('text')}) <= 3 and length(text) <= 80 as wants from conversations")
def hyde_trigger(spark, folder):
    return table(spark, folder, "conversations").select("conv_id", "turn", text.wants_hyde("text").alias("wants"))


@R.add("TXT-10_phrase", "select doc_id, sha256(array_to_string(regexp_extract_all(lower(text), '[가-힣]+|[a-z0-9]+'), ' ')) as phrase_hash from documents")
def phrase(spark, folder):
    return documents(spark, folder).select(F.col("document_id").alias("doc_id"), F.sha2(text.normalize_phrase("text"), 256).alias("phrase_hash"))


@R.add("TXT-11_content_hash", f"select sha256(norm) as content_hash, count(*) as copies, min(doc_id) as first_id from ({DOCS}) group by 1")
def content_hash(spark, folder):
    hashed = documents(spark, folder).select("document_id", text.content_hash(text.normalize_text("text")).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("document_id").alias("first_id"))


NAMED, NAMED_SQL = by_id("doc_id", ["", " 핸드폰 번호", " 휴대폰, 핸드폰.", " 주민번호 과태금 공문", " 핸드폰번호", " 시행일 접수일 시행일"])


def _replaced_sql(value: str) -> tuple[str, str]:
    """The text with whole-word variants replaced, and how many there were, word by word."""
    words = f"regexp_extract_all({value}, '[\\p{{L}}\\p{{N}}_]+')"
    hits = f"len(list_filter({words}, lambda w: list_contains({quoted(list(terms.TERMS))}, w)))"
    out = value
    for variant, canonical in terms.TERMS.items():
        out = f"regexp_replace(regexp_replace({out}, '(^|[^\\p{{L}}\\p{{N}}_]){variant}($|[^\\p{{L}}\\p{{N}}_])', '\\1{canonical}\\2', 'g'), '(^|[^\\p{{L}}\\p{{N}}_]){variant}($|[^\\p{{L}}\\p{{N}}_])', '\\1{canonical}\\2', 'g')"
    return out, hits


REPLACED_SQL, HITS_SQL = _replaced_sql("t")


@R.add("TXT-05_terms", f"with d as (select doc_id, text || {NAMED_SQL} as t from documents) select doc_id, {REPLACED_SQL} as replaced, {HITS_SQL}::bigint as hits from d")
def term_replacement(spark, folder):
    named = table(spark, folder, "documents").select("doc_id", F.concat("text", NAMED()).alias("t"))
    return named.select("doc_id", terms.replace_terms("t").alias("replaced"),
                        F.aggregate(F.map_values(terms.term_counts("t")), F.lit(0), lambda a, n: a + n).alias("hits"))


@R.add("TXT-14_one_line", r"""
select doc_id, trim(substr(trim(regexp_replace(substr(text, 1, 480), '[\s\x00-\x1f]+', ' ', 'g')), 1, 120)) as line from documents""")
def one_line(spark, folder):
    return documents(spark, folder).select(F.col("document_id").alias("doc_id"), context.bounded_line("text", 120).alias("line"))


@R.add("TXT-15_section_path", r"""
select page_id, nullif(array_to_string(list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/')[1:8], lambda p: p <> ''), ' > '), '') as path from pages""")
def section_path(spark, folder):
    parts = F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/")
    return table(spark, folder, "pages").select("page_id", context.metadata_section_path(parts).alias("path"))


@R.add("TXT-16_citations", r"""
with c as (select conv_id, turn, list_transform(regexp_extract_all(text || ' [' || turn::varchar || ']', '\[([0-9]+)\]', 1), lambda x: x::bigint) as cs from conversations)
select conv_id, turn, len(list_filter(cs, lambda x: x between 1 and 3)) as valid, len(list_filter(cs, lambda x: not x between 1 and 3)) as invalid from c""")
def citations(spark, folder):
    cited = F.concat("text", F.lit(" ["), F.col("turn").cast("string"), F.lit("]"))
    return table(spark, folder, "conversations").select("conv_id", "turn", text.citations(cited).alias("c")).select(
        "conv_id", "turn", F.size(F.filter("c", lambda x: x.between(1, 3))).alias("valid"),
        F.size(F.filter("c", lambda x: ~x.between(1, 3))).alias("invalid"))


@R.add("TXT-17_sentences", rf"""
select doc_id, len(list_filter(string_split_regex(text, '[.?!]\s+'), lambda s: length(trim(s, {SQL_SPACE})) > 10)) as sentences from documents""")
def sentences(spark, folder):
    return documents(spark, folder).select(F.col("document_id").alias("doc_id"), F.size(text.sentences_after_stop("text")).alias("sentences"))


@R.add("TXT-18_keywords", f"""
select doc_id, len(k) as keywords, sha256(array_to_string(list_sort(k), ' ')) as keyword_hash
from (select doc_id, {__import__('queryset.common', fromlist=['x']).sql_keywords('text')} as k from documents)""")
def keywords(spark, folder):
    return documents(spark, folder).select("document_id", text.keyword_set("text").alias("k")).select(
        F.col("document_id").alias("doc_id"), F.size("k").alias("keywords"), F.sha2(F.array_join(F.array_sort("k"), " "), 256).alias("keyword_hash"))


@R.add("TXT-19_token_estimate", "select lang, sum(length(text) // 3)::bigint as tokens from documents group by lang")
def token_estimate(spark, folder):
    return documents(spark, folder).groupBy(F.col("project_name").alias("lang")).agg(F.sum(text.token_estimate("text")).alias("tokens"))


@R.add("AGG-21_duplicate_lines", rf"""
with k as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {SQL_SPACE})), lambda x: x <> '') as ne from documents)
select doc_id, len(ne) - len(list_distinct(ne)) as repeated from k""")
def duplicate_lines(spark, folder):
    kept = text.non_empty_lines(text.lines("text"))
    return documents(spark, folder).select("document_id", kept.alias("k")).select(
        F.col("document_id").alias("doc_id"), (F.size("k") - F.size(F.array_distinct("k"))).alias("repeated"))


QUALITY_SQL = f"""
with {MEASURES},
q as (select *, case when norm = '' then 0 else greatest(0, 100 - (case when char_count < 100 then 15 else 0 end) - least(30, 2 * replacement_count)
  - least(20, 2 * control_count) - (case when dup_ratio >= 0.25 then 20 when dup_ratio >= 0.1 then 8 else 0 end) - (case when trim(source) = '' then 5 else 0 end)) end as score,
  list_filter([case when norm = '' then 'EMPTY_DOCUMENT' end, case when norm <> '' and char_count < 100 then 'SHORT_DOCUMENT' end,
   case when replacement_count > 0 then 'ENCODING_REPLACEMENT' end, case when control_count > 0 then 'CONTROL_CHARACTERS' end,
   case when dup_ratio >= 0.25 then 'DUPLICATED_LINES' end, case when dup_ratio >= 0.1 and dup_ratio < 0.25 then 'REPEATED_LINES' end], lambda x: x is not null) as issues from m)"""


@R.add("QLT-01_text_quality", QUALITY_SQL + """
select doc_id, score::bigint as score, case when score >= 90 then 'pass' when score >= 70 then 'warn' else 'fail' end as status, char_count, line_count,
  non_empty_line_count, word_count, replacement_count, control_count, round_even(blank_ratio, 4) as blank_line_ratio,
  round_even(dup_ratio, 4) as duplicate_line_ratio, array_to_string(issues, ',') as issues from q""")
def text_quality(spark, folder):
    scored = quality.text_quality(documents(spark, folder))
    return scored.select(
        F.col("document_id").alias("doc_id"), "score", "status", "char_count", "line_count", "non_empty_line_count", "word_count",
        F.col("replacement_count"), F.col("control_count"), "blank_line_ratio", "duplicate_line_ratio", F.array_join("issues", ",").alias("issues"))


@R.add("QLT-01_quality_by_source", QUALITY_SQL + """
select source, count(*) as docs, round_even(avg(score), 4) as mean_score, count(*) filter (score < 70) as failed from q group by source""")
def quality_by_source(spark, folder):
    scored = quality.text_quality(documents(spark, folder))
    return scored.groupBy(F.col("source_name").alias("source")).agg(
        F.count(F.lit(1)).alias("docs"), rounded(F.avg("score"), 4).alias("mean_score"), F.count_if(F.col("score") < 70).alias("failed"))


# \b stands in for the digit and address look-arounds, which this SQL has not.
EMAIL_SQL = r"len(regexp_extract_all(text, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+'))"
CARD_SQL = r"len(regexp_extract_all(text, '\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b'))"

# Land lines and account numbers, read after cards are taken out; a digit-free edge is consumed.
NO_CARD = r"regexp_replace(text, '\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b', 'card', 'g')"
LAND_LINE = r"(^|[^0-9])(0[2-6][1-5]?)[- .]?(\d{3,4})[- .]?(\d{4})($|[^0-9])"
ACCOUNT = r"(^|[^0-9])(\d{3,6})[- ]\d{2,6}[- ]\d{1,4}(\d{2})($|[^0-9])"
PHONE_SQL = f"len(regexp_extract_all({NO_CARD}, '{LAND_LINE}'))"
ACCOUNT_SQL = f"len(regexp_extract_all({NO_CARD}, '{ACCOUNT}'))"
MILD_SQL, STRONG_SQL = f"({EMAIL_SQL} + {PHONE_SQL})", f"({CARD_SQL} + {ACCOUNT_SQL})"


@R.add("TXT-04_pii_counts", f"""
select doc_id, {EMAIL_SQL} as emails, {CARD_SQL} as cards, {PHONE_SQL} as land_lines, {ACCOUNT_SQL} as accounts from documents
where {MILD_SQL} + {STRONG_SQL} > 0""")
def pii_counts(spark, folder):
    scan = documents(spark, folder).withColumn("s", pii.scan_pii("text"))
    spans = scan.select("document_id", F.explode(pii.pii_spans(F.col("s"))).alias("p"))
    return spans.groupBy(F.col("document_id").alias("doc_id")).agg(
        F.count_if(F.col("p.category") == "이메일주소").alias("emails"), F.count_if(F.col("p.category") == "신용카드번호").alias("cards"),
        F.count_if(F.col("p.category") == "일반전화번호").alias("land_lines"), F.count_if(F.col("p.category") == "계좌번호").alias("accounts"))


MASK_SQL = (
    r"regexp_replace(regexp_replace(text, '([a-zA-Z0-9_.+-]{2})[a-zA-Z0-9_.+-]+@([a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+)', '\1***@\2', 'g'), "
    r"'\b(\d{4})[- ]?\d{4}[- ]?\d{4}[- ]?(\d{4})\b', '\1-****-****-\2', 'g')"
)
MASK_SQL = (
    f"regexp_replace(regexp_replace({MASK_SQL}, '{LAND_LINE}', " + r"'\1\2-****-\4\5', 'g'), '" + ACCOUNT + r"', '\1\2-****-**\3\4', 'g')"
)


@R.add("TXT-04_masked_text", f"select doc_id, sha256({MASK_SQL}) as masked_hash from documents")
def masked_text(spark, folder):
    return documents(spark, folder).select(F.col("document_id").alias("doc_id"), F.sha2(pii.mask_pii("text"), 256).alias("masked_hash"))


@R.add("QLT-02_enterprise_quality", rf"""
with {MEASURES.replace(DOCS, f"select doc_id, source, {MASK_SQL} as norm, {MILD_SQL} + {STRONG_SQL} as found from documents")
      .replace("m as (select doc_id, source, norm,", "m as (select doc_id, found, norm,")
      .replace("string_split(norm, chr(10)) end as ls", "case when norm[-1] = chr(10) then string_split(norm, chr(10))[:-2] else string_split(norm, chr(10)) end end as ls")},
p as (select doc_id, found, norm, 20 - case when char_count < 100 then 10 else 0 end - case when blank_ratio > 0.4 then 5 else 0 end as completeness,
  20 - least(10, control_count) as validity, 20 - case when dup_ratio >= 0.25 then 12 when dup_ratio >= 0.1 then 5 else 0 end as consistency,
  20 - least(5, found) as integrity, 20 - least(15, 3 * replacement_count) as accuracy from m),
s as (select *, case when norm = '' then 0 else completeness + validity + consistency + integrity + accuracy end as score from p)
select doc_id, score, case when score >= 90 then 'pass' when score >= 70 then 'warn' else 'fail' end as status, completeness::bigint as completeness,
  validity, consistency::bigint as consistency, integrity, accuracy, found as pii_detected_count from s""")
def enterprise_quality(spark, folder):
    return quality.enterprise_quality(documents(spark, folder)).select(
        F.col("document_id").alias("doc_id"), "score", "status", "completeness", "validity", "consistency", "integrity", "accuracy", "pii_detected_count")


@R.add("VEC-01_hash_embedding", f"""
with recursive {__import__('queryset.common', fromlist=['x']).sql_hash_vectors('v', 'documents', 'doc_id', 'text')}
select id as doc_id, slot::bigint as slot, round_even(x, 6) as weight from v""")
def hash_embedding(spark, folder):
    embedded = documents(spark, folder).select("document_id", F.posexplode(vectors.hash_embedding("text", 64)).alias("slot", "w"))
    return embedded.where("w > 0").select(F.col("document_id").alias("doc_id"), "slot", rounded("w", 6).alias("weight"))


@R.add("MTH-01_half_even", "select l_orderkey, l_linenumber, round_even(l_quantity / 8, 2) as v from lineitem")
def half_even(spark, folder):
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", text.rounded(F.col("l_quantity") / 8, 2).alias("v"))


@R.add("JSN-01_json_path", "select event_id, props->>'$.k' as k, (props->>'$.missing') is null as missing from events")
def json_path(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.missing").isNull().alias("missing"))


@R.add("JSN-02_first_json", "select event_id, (props->>'$.k')::bigint as k from events")
def first_json(spark, folder):
    answer = F.concat(F.lit("```json\nResult: "), "props", F.lit(" and {more}\n```"))
    return table(spark, folder, "events").select("event_id", text.first_json_object(answer).alias("j")).select(
        "event_id", F.get_json_object("j", "$.k").cast("bigint").alias("k"))


@R.add("JSN-03_schema_extract", "select event_id, props->>'$.k' as k, 'x' as listed from events")
def schema_extract(spark, folder):
    answer = F.concat(F.lit('{"k": "'), F.get_json_object("props", "$.k"), F.lit('", "items": ["x"], "other": 1}'))
    parsed = files.schema_fields(answer, {"k": "string", "items": "list"})
    return table(spark, folder, "events").select("event_id", parsed.alias("p")).select("event_id", "p.k", F.element_at("p.items", 1).alias("listed"))


@R.add("SRC-12_data_uri", "select event_id, 'data:application/json;base64,' || to_base64(props::blob) as uri from events")
def data_uri(spark, folder):
    return table(spark, folder, "events").select("event_id", text.data_uri(F.encode("props", "utf-8"), "application/json").alias("uri"))


@R.add("SRC-06_json_text", """select event_id, '{' || chr(10) || '  "k": ' || (props->>'$.k') || chr(10) || '}' as text from events""")
def json_text(spark, folder):
    df = fan_out(table(spark, folder, "events"), "event_id").select(
        "event_id", F.lit("event.json").alias("name"), F.encode("props", "utf-8").alias("payload"))
    return files.parse_documents(df).select("event_id", "parsed.text")


@R.add("SRC-01_parse_dispatch", f"""
select doc_id, 'text' as parser, case when norm = '' then 'empty' else 'success' end as status, length(norm) as characters from ({DOCS})""")
def parse_dispatch(spark, folder):
    df = documents(spark, folder).select("document_id", F.lit("note.txt").alias("name"), F.encode("text", "utf-8").alias("payload"))
    return files.parse_documents(df).select(
        F.col("document_id").alias("doc_id"), F.col("parsed.metadata")["parser"].alias("parser"),
        F.col("parsed.metadata")["extraction_status"].alias("status"), F.length("parsed.text").alias("characters"))


@R.add("SRC-02_decode_ladder", "select doc_id, sha256(text) as text_hash from documents")
def decode_ladder(spark, folder):
    return documents(spark, folder).select(F.col("document_id").alias("doc_id"), F.sha2(files.decode_bytes(F.encode("text", "utf-8")), 256).alias("text_hash"))


@R.add("SRC-03_csv_text", """
select p_partkey, '| p_name | p_brand |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || trim(p_name) || ' | ' || trim(p_brand) || ' |' as text from part""")
def csv_text(spark, folder):
    payload = F.concat(F.lit("p_name,p_brand\n\n"), "p_name", F.lit(" , "), "p_brand", F.lit("\n"))
    df = fan_out(table(spark, folder, "part"), "p_partkey").select("p_partkey", F.lit("part.csv").alias("name"), F.encode(payload, "utf-8").alias("payload"))
    return files.parse_documents(df).select("p_partkey", "parsed.text")


@R.add("SRC-05_html_text")
def html_text(spark, folder):
    df = fan_out(table(spark, folder, "pages"), "page_id").select("page_id", F.lit("page.html").alias("name"), F.encode("html", "utf-8").alias("payload"))
    return files.parse_documents(df).select("page_id", "parsed.text")


@R.add("SRC-16_markdown_tables", """
select p_partkey, 0::bigint as table_index, 1::bigint as row_index, trim(p_name) as first, p_brand as second from part""")
def markdown_tables(spark, folder):
    doc = F.concat(F.lit("intro\n| name | brand |\n| --- | :---: |\n| "), "p_name", F.lit(" | "), "p_brand", F.lit(" |\ntail\n| lonely |\n"))
    found = files.markdown_tables(fan_out(table(spark, folder, "part"), "p_partkey").select("p_partkey", doc.alias("text")), "p_partkey", "text")
    return found.where("row_index > 0").select("p_partkey", "table_index", "row_index", F.col("cells")[0].alias("first"), F.col("cells")[1].alias("second"))


@R.add("SRC-17_records", "select event_id, (props->>'$.k') as k from events")
def records(spark, folder):
    rows = files.records_table(table(spark, folder, "events").select("event_id", F.from_json("props", "map<string,string>").alias("r")), "event_id", "r", ["k"])
    return rows.select("event_id", "k")


# Texts that hold what the walk must see: a table of five rows at a place that differs by document, and its own words around it.
TABLE_ROWS = "| name | amount | remark |\n"


def tabled_documents(spark, folder):
    cut = F.col("document_id") % 1500 + 60
    parts = F.substring("text", F.lit(1), cut), F.lit("\n" + TABLE_ROWS * 5), F.substring("text", cut + 1, F.length("text"))
    return documents(spark, folder).withColumn("text", F.concat(*parts))


TABLED = DOCS.replace(
    "from documents", f"from (select doc_id, source, lang, left(text, doc_id % 1500 + 60) || '{chr(10)}{TABLE_ROWS * 5}' || substr(text, doc_id % 1500 + 61) as text from documents)")


@R.add("TXT-02_table_chunks", f"""
with recursive src as (select doc_id as id, norm as t from ({TABLED})), {sql_chunks('ch', 'src', 400, 60)}
select id as document_id, chunk_index, text, char_start, char_end from ch""")
def table_chunks(spark, folder):
    """Chunks of texts with a table inside, many of which would end inside a row."""
    return chunking.explode_chunks(tabled_documents(spark, folder), chunking.chunk_array("text", 400, 60), ["document_id"]).drop("parent_index", "parent_text")


@R.add("TXT-02_chunks", f"""
with recursive src as (select doc_id as id, norm as t from ({DOCS})), {sql_chunks('ch', 'src', 1600, 240)}
select id as document_id, chunk_index, text, char_start, char_end from ch""")
def chunks(spark, folder):
    return chunking.explode_chunks(documents(spark, folder), chunking.chunk_array("text"), ["document_id"]).drop("parent_index", "parent_text")


@R.add("TXT-03_parent_child", f"""
with recursive src as (select doc_id as id, norm as t from ({DOCS})), {sql_chunks('pa', 'src', 1200, 120)},
sub as (select id * 1000000 + chunk_index as id, text as t from pa), {sql_chunks('ch', 'sub', 280, 40)}
select pa.id as document_id, row_number() over (partition by pa.id order by pa.chunk_index, ch.chunk_index) - 1 as chunk_index, ch.text,
  pa.char_start + ch.char_start as char_start, least(pa.char_end, pa.char_start + ch.char_end) as char_end,
  pa.chunk_index as parent_index, pa.text as parent_text
from pa join ch on ch.id = pa.id * 1000000 + pa.chunk_index""")
def parent_child(spark, folder):
    return chunking.explode_chunks(documents(spark, folder), chunking.parent_child_array("text"), ["document_id"])


@R.add("TXT-02_chunk_coverage", f"select doc_id, length(norm) as covered_to from ({DOCS}) where norm <> ''")
def chunk_coverage(spark, folder):
    """The last chunk of every document ends where its normalized text ends."""
    parts = chunking.explode_chunks(documents(spark, folder), chunking.chunk_array("text"), ["document_id"])
    return parts.groupBy(F.col("document_id").alias("doc_id")).agg(F.max("char_end").alias("covered_to"))


@R.add("TXT-12_context_prefix", """
select doc_id, '문서 제목: ' || source || chr(10) || '섹션 경로: ' || lang || ' > ' || source as prefix from documents""")
def context_prefix(spark, folder):
    path = context.metadata_section_path(F.array("project_name", "source_name"))
    return documents(spark, folder).select(
        F.col("document_id").alias("doc_id"), context.context_prefix(F.col("source_name"), path, F.lit(None).cast("string")).alias("prefix"))


def sql_line(value: str, limit: int) -> str:
    return rf"trim(left(trim(regexp_replace(left({value}, {limit * 4}), '[\pC\s]+', ' ', 'g')), {limit}))"


# Titles, labels and summaries that reach every limit, and blank ones.
@R.add("TXT-12_bounded_prefix", rf"""
with p as (select doc_id, {sql_line("repeat(source || chr(9), (doc_id % 40)::int)", 120)} as title, {sql_line('repeat(source, (doc_id % 50)::int)', 120)} as label,
  {sql_line("case when doc_id % 3 > 0 then text end", 320)} as summary, lang from documents),
q as (select *, {sql_line("array_to_string(list_filter([lang, label, ' ', label, label], lambda x: trim(x) <> ''), ' > ')", 280)} as path from p)
select doc_id, concat_ws(chr(10), case when title <> '' then '문서 제목: ' || title end, case when path <> '' then '섹션 경로: ' || path end,
  case when summary <> '' then '문서 요약: ' || summary end) as prefix from q""")
def bounded_prefix(spark, folder):
    again = lambda c, n: F.repeat(c, (F.col("document_id") % n).cast("int"))
    label = again(F.col("source_name"), 50)
    path = context.metadata_section_path(F.array(F.col("project_name"), label, F.lit(" "), label, label))
    title = again(F.concat("source_name", F.lit("\t")), 40)
    summary = F.when(F.col("document_id") % 3 > 0, F.col("text"))
    return documents(spark, folder).select(F.col("document_id").alias("doc_id"), context.context_prefix(title, path, summary).alias("prefix"))


# Headings of every shape put before every second line, chosen by the document and the line.
HEADS = ["# Whole work #", "## First aims", "### Notes and aims", "2.1 Second part", "제 3 장 총칙", "제4조(목적) 이 규정", "가. 세부 사항", "1) list item",
         "1.2.3.4.5 deep down", "#### Deep", "제 2 절", "#no heading"]


def headed_documents(spark, folder):
    head = lambda i: F.element_at(F.array(*map(F.lit, HEADS)), ((F.col("document_id") + i * i) % len(HEADS) + 1).cast("int"))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 2 == 0, F.concat(head(i), F.lit("\n"), x)).otherwise(x))
    return documents(spark, folder).withColumn("text", F.array_join(lines, "\n"))


HEADED = DOCS.replace("from documents", f"""from (select doc_id, source, lang, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
  case when i % 2 = 1 then ({quoted(HEADS)}[((doc_id + (i - 1) * (i - 1)) % {len(HEADS)} + 1)::int]) || chr(10) || x else x end), chr(10)) as text from documents)""")


@R.add("TXT-13_headings", rf"""
with recursive src as (select doc_id as id, norm as t from ({HEADED})), {sql_chunks('ch', 'src', 400, 60)},
li as (select id, i, {sql_strip('x')} as x, coalesce(sum(length(x) + 1) over (partition by id order by i rows between unbounded preceding and 1 preceding), 0) as b
  from (select id, unnest(ps) as x, generate_subscripts(ps, 1) as i from (select id, string_split(t, chr(10)) as ps from src))),
lv as (select id, b, x, case when regexp_full_match(x, '#{{1,4}}\s+.+') then length(regexp_extract(x, '^#+'))
  when regexp_full_match(x, '\d+([.]\d+)*[.)]?\s+.{{2,120}}') then least(4, 1 + length(regexp_replace(regexp_extract(x, '^\d+([.]\d+)*'), '[^.]', '', 'g')))
  when regexp_full_match(x, '제\s*\d+\s*장(\s+.+)?') then 1 when regexp_full_match(x, '제\s*\d+\s*절(\s+.+)?') then 2
  when regexp_full_match(x, '제\s*\d+\s*조([(][^)]*[)])?(\s+.+)?') then 3 when regexp_full_match(x, '[가-하][.)]\s+.{{2,120}}') then 4 end as level from li),
hd as (select id, b, level, rtrim(left(regexp_replace(regexp_replace(regexp_replace(x, '^#+\s+', ''), case when x[1] = '#' then '\s*#*\s*$' else '$' end, ''), '\s+', ' ', 'g'), 120)) as label
  from lv where level is not null),
cl as (select h.id, h.b, h.level, any_value(h.label) as label, min(later.b) as closed from hd h left join hd later on later.id = h.id and later.b > h.b and later.level <= h.level group by all),
pa as (select ch.id, chunk_index, rtrim(left(string_agg(label, ' > ' order by b), 280)) as section_path
  from ch join cl on cl.id = ch.id and b <= char_start and (closed is null or closed > char_start) group by all)
select ch.id as document_id, ch.chunk_index, section_path from ch left join pa on pa.id = ch.id and pa.chunk_index = ch.chunk_index""")
def headings(spark, folder):
    """Headings open at the start of every chunk, for texts that hold headings of every shape."""
    docs = headed_documents(spark, folder)
    parts = chunking.explode_chunks(docs, chunking.chunk_array("text", 400, 60), ["document_id"]).select("document_id", "chunk_index", "char_start")
    texts = docs.select("document_id", text.normalize_text("text").alias("t"))
    return context.with_section_paths(parts, "char_start", texts, "document_id", "t").drop("char_start")


@R.add("JOIN-02_chunk_counts", """
select d.doc_id, count(l.doc_id) as chunk_count from documents d left join labels l using (doc_id) group by d.doc_id""")
def chunk_counts(spark, folder):
    """Documents with their number of child rows, none included; labels are the children."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("document_id"))
    return catalog.chunk_counts(docs, table(spark, folder, "labels").select(F.col("doc_id").alias("document_id"))).withColumnRenamed("document_id", "doc_id")


@R.add("DML-01_insert_new", f"""
with n as (select *, sha256(norm) as h from ({DOCS})), stored as (select distinct source, h from n where lang <> 'en')
select source, lang, h as content_hash, min(doc_id) as doc_id from n where lang = 'en' and not exists (select 1 from stored s where s.source = n.source and s.h = n.h)
group by source, lang, h""")
def insert_new(spark, folder):
    hashed = documents(spark, folder).withColumn("content_hash", text.content_hash(text.normalize_text("text"))).drop("text")
    fresh = catalog.new_documents(hashed.where("project_name = 'en'"), hashed.where("project_name <> 'en'"), ["source_name", "content_hash"])
    return fresh.select(F.col("source_name").alias("source"), F.col("project_name").alias("lang"), "content_hash", F.col("document_id").alias("doc_id"))


@R.add("DML-02_replace_source", """
select doc_id, source from documents where lang = 'en' or (source, 'x') not in (select source, 'x' from documents where lang = 'en')""")
def replace_source(spark, folder):
    docs = documents(spark, folder).drop("text")
    kept = catalog.replace_sources(docs.where("project_name <> 'en'"), docs.where("project_name = 'en'"), ["source_name"])
    return kept.select(F.col("document_id").alias("doc_id"), F.col("source_name").alias("source"))


@R.add("DML-03_delete_cascade", """
select (select count(*) from documents where doc_id not in (select doc_id from labels where toxic = 1)) as documents,
  (select count(*) from labels where doc_id not in (select doc_id from labels where toxic = 1)) as children""")
def delete_cascade(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("document_id"))
    children = table(spark, folder, "labels").select(F.col("doc_id").alias("document_id"), "toxic")
    left, rest = catalog.delete_documents(docs, children, children.where("toxic = 1"))
    return catalog.statistics(left, rest).select(F.col("total_documents").alias("documents"), F.col("total_chunks").alias("children"))


@R.add("DML-04_scoped_delete", """
select doc_id from documents where not (lang = 'fr' and doc_id in (select doc_id from labels where toxic = 1))""")
def scoped_delete(spark, folder):
    docs = documents(spark, folder).drop("text")
    children = table(spark, folder, "labels").select(F.col("doc_id").alias("document_id"), "toxic")
    left, _rest = catalog.delete_documents(docs, children, children.where("toxic = 1"), "fr")
    return left.select(F.col("document_id").alias("doc_id"))


@R.add("CMP-01_document_comparison", f"""
with {MEASURES},
a as (select doc_id, char_count, len(norm) as n, case when char_count < 100 then 15 else 0 end + case when dup_ratio >= 0.25 then 20 when dup_ratio >= 0.1 then 8 else 0 end as lost,
  list_filter([case when char_count < 100 then 'SHORT_DOCUMENT' end, case when dup_ratio >= 0.25 then 'DUPLICATED_LINES' end,
    case when dup_ratio >= 0.1 and dup_ratio < 0.25 then 'REPEATED_LINES' end], lambda x: x is not null) as issues, source from m),
s as (select doc_id, source, char_count, 100 - lost as score, issues from a),
b as (select doc_id, list_distinct(ne) as ln from kept),
c as (select doc_id, len(array_to_string(ln, chr(10))) as char_count, 100 - case when len(array_to_string(ln, chr(10))) < 100 then 15 else 0 end as score,
  case when len(array_to_string(ln, chr(10))) < 100 then ['SHORT_DOCUMENT'] else [] end as issues from b)
select s.doc_id, c.score - s.score + 0.0 as score_delta, c.char_count - s.char_count as extracted_character_delta,
  array_to_string(list_sort(list_filter(s.issues, lambda x: not list_contains(c.issues, x))), ',') as resolved,
  array_to_string(list_sort(list_filter(c.issues, lambda x: not list_contains(s.issues, x))), ',') as introduced,
  array_to_string(list_sort(list_filter(c.issues, lambda x: list_contains(s.issues, x))), ',') as remaining from s join c using (doc_id)""")
def document_comparison(spark, folder):
    """Each document against its version without blank and repeated lines."""
    docs = documents(spark, folder).withColumn("text", text.normalize_text("text"))
    cleaned = docs.withColumn("text", F.array_join(F.array_distinct(text.non_empty_lines(text.lines("text"))), "\n"))

    def side(df):
        return quality.text_quality(df, normalized=True).select(
            "document_id", F.lit("txt").alias("extension"), F.lit("text").alias("parser"), F.lit(None).cast("string").alias("ocr_version"),
            "score", "issues", "char_count")

    joined = compare.compare_documents(side(docs), side(cleaned))
    return joined.select(
        F.col("document_id").alias("doc_id"), "score_delta", "extracted_character_delta",
        *[F.array_join(c, ",").alias(c) for c in ("resolved", "introduced", "remaining")])


@R.add("CMP-01_matching_blocks", f"""
with {MEASURES}, a as (select doc_id, unnest(ne) as line from kept), o as (select doc_id, line, count(*) as n from a group by all)
select doc_id, sum(n)::bigint as original_candidate_count, count(*) as cleaned_candidate_count, count(*) as exact_matching_candidate_count,
  (sum(n) - count(*))::bigint as removed_candidate_count, 0::bigint as introduced_candidate_count from o group by doc_id""")
def matching_blocks(spark, folder):
    docs = documents(spark, folder).select("document_id", text.non_empty_lines(text.lines(text.normalize_text("text"))).alias("l"))
    block = lambda array: docs.select("document_id", F.lit("line").alias("kind"), F.explode(array).alias("text"))
    return compare.matching_blocks(block(F.col("l")), block(F.array_distinct("l"))).withColumnRenamed("document_id", "doc_id")


@R.add("SET-02_rule_changes", """
select l1.l_orderkey, l1.n as resolved, l2.n as introduced from
 (select o_orderkey as l_orderkey, (select count(distinct l_returnflag) from lineitem where l_orderkey = o_orderkey and l_returnflag not in ('N')) as n from orders) l1
 join (select o_orderkey as l_orderkey, (select case when count(*) > 0 and bool_or(l_returnflag = 'N') then 0 else 1 end from lineitem where l_orderkey = o_orderkey) as n from orders) l2 using (l_orderkey)
where exists (select 1 from lineitem where lineitem.l_orderkey = l1.l_orderkey)""")
def rule_changes(spark, folder):
    flags = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("f"))
    changed = compare.rule_changes(F.col("f"), F.array(F.lit("N")), F.lit(True))
    return flags.select("l_orderkey", changed.alias("c")).select("l_orderkey", F.size("c.resolved").alias("resolved"), F.size("c.introduced").alias("introduced"))


@R.add("PLAN_ingest_documents", f"""
with n as (select doc_id, source, lang, {sql_strip("regexp_replace(regexp_replace(mk, '[ \t]+" + chr(92) + "n', chr(10), 'g'), '" + chr(92) + "n{3,}', chr(10) || chr(10), 'g')")} as norm from (select *, {MASK_SQL} as mk from documents)),
h as (select *, sha256(norm) as h from n where norm <> '')
select source as source_name, lang as project_name, h as content_hash, min(doc_id) as document_id from h group by all""")
def ingest_documents(spark, folder):
    docs, _chunks = ingest.ingest(documents(spark, folder), dim=64)
    return docs.select("source_name", "project_name", "content_hash", "document_id")


@R.add("PLAN_ingest_chunks", f"""
with recursive n as (select doc_id, source, lang, {sql_strip("regexp_replace(regexp_replace(mk, '[ \t]+" + chr(92) + "n', chr(10), 'g'), '" + chr(92) + "n{3,}', chr(10) || chr(10), 'g')")} as norm from (select *, {MASK_SQL} as mk from documents)),
h as (select min(doc_id) as doc_id from n where norm <> '' group by source, lang, norm),
src as (select doc_id as id, norm as t from n semi join h using (doc_id)), {sql_chunks('ch', 'src', 1600, 240)}
select id || ':' || chunk_index as chunk_id, id as document_id, chunk_index, text as content, char_start, char_end from ch""")
def ingest_chunks(spark, folder):
    _docs, parts = ingest.ingest(documents(spark, folder), dim=64)
    return parts.select("chunk_id", "document_id", "chunk_index", "content", "char_start", "char_end")
