"""Telemetry, samples, projections, streams and whole plans."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpusmill.config import Settings
from corpusmill.functions.pii import mask_pii
from corpusmill.functions.text import rounded
from corpusmill.operators import catalog, filters, profile, ranking, samples, telemetry
from corpusmill.plans import answer
from corpusmill.session import fan_out, scratch_folder
from corpusmill.sources import store
from corpusmill.sources import tables as S
from corpusmill.streaming import cache, counters, guarded

from .common import Registry
from .corpus import MASK_SQL

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

TRACES = """
t as (select event_id as id, ts as created_at, user_id as client, value as total_latency_ms, (props->>'$.k')::bigint as total_tokens,
  case when event_type = 'error' then 'block' when event_type = 'signup' then 'mask' else 'allow' end as guardrail_action,
  case when value > 50 then 'high' else 'low' end as hallucination_risk, 'event ' || event_type || ' ' || user_id as query_text,
  case when event_type <> 'error' then 'answer ' || value end as answer_text from events),
f as (select event_id as trace_id, case when event_type = 'purchase' then 1 when event_type = 'error' then -1 else 0 end as thumbs,
  (props->>'$.k')::int % 5 + 1 as rating, case when value > 80 then 'corrected' end as corrected_answer from events where event_type in ('purchase', 'error', 'view'))"""


@R.add("AGG-13_trace_summary", f"""
with {TRACES} select count(*) as total_queries, round_even(avg(total_latency_ms), 1) as avg_latency_ms, sum(total_tokens)::bigint as total_tokens, 0.0::double as estimated_cost_usd,
  round_even(count(*) filter (guardrail_action = 'block') / greatest(1, count(*)), 3) as guardrail_block_rate, count(*) filter (hallucination_risk = 'high') as high_hallucination_count from t""")
def trace_summary(spark, folder):
    return telemetry.trace_summary(S.traces(spark, folder))


@R.add("AGG-14_feedback_summary", f"""
with {TRACES} select count(*) as feedback_count, round_even(avg(rating), 2) as avg_rating, count(*) filter (thumbs > 0) as thumbs_up, count(*) filter (thumbs < 0) as thumbs_down from f""")
def feedback_summary(spark, folder):
    return telemetry.feedback_summary(S.feedback(spark, folder))


@R.add("AGG-15_system_stats", "select (select count(*) from documents) as total_documents, (select count(*) from labels) as total_chunks")
def system_stats(spark, folder):
    return catalog.statistics(S.table(spark, folder, "documents"), S.table(spark, folder, "labels"))


REQUESTS = """
r as (select case when event_type = 'view' then 'GET' else 'POST' end as method, '/' || event_type as endpoint, case when value > 60 then 500 else 200 end as status, value / 1000 as seconds from events)"""


@R.add("AGG-19_request_counts", f"with {REQUESTS} select method, endpoint, status::bigint as status, count(*) as requests from r group by all")
def request_counts(spark, folder):
    return telemetry.request_metrics(S.requests(spark, folder))[0]


@R.add("AGG-19_request_durations", f"with {REQUESTS} select method, endpoint, round_even(sum(seconds), 4) as seconds, count(*) as requests from r group by all")
def request_durations(spark, folder):
    return telemetry.request_metrics(S.requests(spark, folder))[1].withColumn("seconds", rounded("seconds", 4))


@R.add("SRC-29_metric_lines", f"""
with {REQUESTS}, c as (select method, endpoint, status, count(*) as n from r group by all), d as (select method, endpoint, sum(seconds) as s, count(*) as n from r group by all)
select line from (
select 'rag_http_requests_total{{endpoint="' || endpoint || '",method="' || method || '",status="' || status || '"}} ' || n as line from c
union all select 'rag_http_request_duration_seconds_sum{{endpoint="' || endpoint || '",method="' || method || '"}} ' || printf('%.6f', s) from d
union all select 'rag_http_request_duration_seconds_count{{endpoint="' || endpoint || '",method="' || method || '"}} ' || n from d
union all select unnest(['# HELP rag_http_requests_total Total number of HTTP requests processed by endpoint and status.', '# TYPE rag_http_requests_total counter',
  '# HELP rag_http_request_duration_seconds HTTP request duration in seconds.', '# TYPE rag_http_request_duration_seconds summary']))""")
def metric_lines(spark, folder):
    return telemetry.prometheus_lines(S.requests(spark, folder)).select("line")


@R.add("JOIN-03_traces_with_feedback", f"with {TRACES} select id, guardrail_action, thumbs, rating from t join f on t.id = f.trace_id")
def traces_with_feedback(spark, folder):
    traces, feedback = S.traces(spark, folder), S.feedback(spark, folder)
    return traces.join(feedback, traces["id"] == feedback["trace_id"]).select("id", "guardrail_action", "thumbs", "rating")


@R.add("TOP-07_recent_traces", f"with {TRACES} select id, client, guardrail_action from t order by created_at desc, id limit 50")
def recent_traces(spark, folder):
    return telemetry.recent(S.traces(spark, folder), 50, "id").select("id", "client", "guardrail_action")


@R.add("FLT-13_recent_blocked", f"with {TRACES} select id, client from t where guardrail_action = 'block' order by created_at desc, id limit 50")
def recent_blocked(spark, folder):
    return telemetry.recent(S.traces(spark, folder), 50, "id", "block").select("id", "client")


@R.add("TOP-06_document_page", "select doc_id, source from documents order by n_chars desc, doc_id limit 20 offset 40")
def document_page(spark, folder):
    docs = S.table(spark, folder, "documents").select("doc_id", "source", "n_chars")
    return filters.page(docs, [F.desc("n_chars"), F.asc("doc_id")], 20, 40).select("doc_id", "source")


@R.add("TOP-09_value_sample", "select user_id, event_id, rank from (select user_id, event_id, row_number() over (partition by user_id order by event_id) as rank from events) where rank <= 20")
def value_sample(spark, folder):
    return ranking.top_k(S.table(spark, folder, "events").select("user_id", "event_id"), ["user_id"], [F.asc("event_id")], 20)


@R.add("TOP-01_latency_top", f"with {TRACES} select id, total_latency_ms from t order by total_latency_ms desc, id limit 25")
def latency_top(spark, folder):
    return ranking.top_k_global(S.traces(spark, folder).select("id", "total_latency_ms"), [F.desc("total_latency_ms"), F.asc("id")], 25)


@R.add("DML-08_curated_samples", f"""
with {TRACES} select trace_id, query_text as input, coalesce(corrected_answer, answer_text) as output from t join f on t.id = f.trace_id
where (thumbs > 0 or rating >= 4 or corrected_answer is not null) and answer_text is not null""")
def curated_samples(spark, folder):
    return telemetry.curated_samples(S.traces(spark, folder), S.feedback(spark, folder))


@R.add("TXT-21_conversation_turns", """
select conv_id, -1::bigint as seq, '<|im_start|>system' || chr(10) || '당신은 행정 문서 및 RAG 지식 기반 전문 AI 어시스턴트입니다.<|im_end|>' as segment from conversations group by conv_id
union all select conv_id, turn, '<|im_start|>' || case when role in ('gpt', 'assistant', 'bot') then 'assistant' else 'user' end || chr(10) || text || '<|im_end|>' from conversations""")
def conversation_turns(spark, folder):
    return samples.conversation_turns(S.table(spark, folder, "conversations"), "conv_id", "turn", "role", "text")


@R.add("TXT-21_alpaca", f"""
with {TRACES} select trace_id, '아래는 작업을 설명하는 지침과 추가 컨텍스트를 제공하는 입력의 조합입니다. 요청을 적절히 완료하는 응답을 작성하십시오.' || chr(10) || chr(10) || '### 지침:' || chr(10)
  || '다음 질의에 대해 신뢰할 수 있는 정확한 답변을 작성하십시오.' || chr(10) || chr(10) || '### 입력:' || chr(10) || query_text || chr(10) || chr(10) || '### 응답:' || chr(10) || coalesce(corrected_answer, answer_text) as prompt
from t join f on t.id = f.trace_id where (thumbs > 0 or rating >= 4 or corrected_answer is not null) and answer_text is not null""")
def alpaca(spark, folder):
    curated = telemetry.curated_samples(S.traces(spark, folder), S.feedback(spark, folder))
    return curated.select("trace_id", samples.alpaca_prompt(F.lit(samples.CURATED_INSTRUCTION), "input", "output").alias("prompt"))


@R.add("TXT-22_label_ranges", """
with p as (select a.conv_id, a.turn, length('<|im_start|>user' || chr(10) || b.text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)) as s, length(a.text) as n
  from conversations a join conversations b on b.conv_id = a.conv_id and b.turn = a.turn - 1 where a.role = 'assistant')
select conv_id, turn, s as first_start, s + n + 10 as first_end, 1::bigint as ranges from p""")
def label_ranges(spark, folder):
    """One question and its answer as a prompt; only the answer and its end mark are trained on."""
    rows = S.exchanges(spark, folder)
    prompt = F.concat_ws("\n", samples.chat_turn(F.lit("user"), "query"), samples.chat_turn(F.lit("assistant"), "answer"))
    spans = rows.select("conv_id", "turn", samples.label_ranges(prompt).alias("r"))
    return spans.select("conv_id", "turn", F.col("r")[0]["start"].alias("first_start"), F.col("r")[0]["end"].alias("first_end"), F.size("r").alias("ranges"))


@R.add("TXT-23_split_is_total", "select count(*) as samples, true as balanced from conversations")
def split_is_total(spark, folder):
    """Every row falls on one side and about nine in ten on the first; which one only the hash of this engine decides."""
    keyed = S.table(spark, folder, "conversations").withColumn("key", F.concat_ws(":", "conv_id", "turn"))
    marked = samples.train_validation(keyed, "key")
    share = F.avg((F.col("split") == "train").cast("int"))
    return marked.agg(F.count("split").alias("samples"), share.between(0.85, 0.95).alias("balanced"))


@R.add("FLT-15_omitted_keys", """
select event_id, (props->>'$.k') as kept, 3::bigint as keys,
  '{"a":{"' || event_type || '":1},"b":[{"ok":2}]}' as nested, null::varchar as broken from events""")
def omitted_keys(spark, folder):
    report = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(
        F.lit("Raw_Text"), F.col("event_type"), F.lit("file-path"), F.col("event_type"), F.lit("content"), F.lit("x"),
        F.lit("deep"), F.concat(F.lit('{"a":{"Content":"x","'), F.col("event_type"), F.lit('":1},"b":[{"file_path":"y","ok":2}]}')),
        F.lit("cut"), F.lit('{"extracted-text": "unfinished')))
    df = S.table(spark, folder, "events").select("event_id", filters.drop_source_keys(report).alias("m"))
    return df.select("event_id", F.col("m")["k"].alias("kept"), F.size("m").alias("keys"), F.col("m")["deep"].alias("nested"), F.col("m")["cut"].alias("broken"))


@R.add("FLT-16_safe_report", """select event_id, value as score, '[{"kind":"' || event_type || '","start":3}]' as details from events""")
def safe_report(spark, folder):
    found = F.struct(F.col("event_type").alias("kind"), F.col("props").alias("original"), F.col("props").alias("snippet"), F.col("props").alias("matched_text"), F.lit(3).alias("start"))
    report = F.struct(F.col("value").alias("score"), F.col("event_type").alias("cleaned_text"), F.array(found).alias("pii_details"))
    safe = S.table(spark, folder, "events").select("event_id", filters.safe_report(report).alias("r"))
    return safe.select("event_id", "r.score", F.to_json("r.pii_details").alias("details"))


@R.add("FLT-17_source_metadata", """
with m as (select event_id, case event_id % 3 when 0 then 'parent_text' when 1 then 'Parent_Text' else 'note' end as key, event_type from events)
select event_id, case when key = 'parent_text' then 1 else 2 end::bigint as keys, event_type as source,
  case when key <> 'parent_text' then key end as other from m""")
def source_metadata(spark, folder):
    key = F.when(F.col("event_id") % 3 == 0, "parent_text").when(F.col("event_id") % 3 == 1, "Parent_Text").otherwise("note")
    metadata = F.create_map(F.lit("source"), F.col("event_type"), key, F.col("props"))
    df = S.table(spark, folder, "events").select("event_id", filters.source_metadata(metadata).alias("m"))
    others = F.filter(F.map_keys("m"), lambda k: k != "source")
    return df.select("event_id", F.size("m").alias("keys"), F.col("m")["source"].alias("source"), F.try_element_at(others, F.lit(1)).alias("other"))


@R.add("FLT-18_app_response", f"""
select doc_id, substr({MASK_SQL}, 1, 1200) as text, substr(source, 1, 256) as source_name, least(1.0, n_chars / 1000) as score from documents""")
def app_response(spark, folder):
    docs = fan_out(S.table(spark, folder, "documents"), "doc_id").select("doc_id", "text", F.col("source").alias("source_name"), (F.col("n_chars") / 1000).alias("score"))
    return filters.app_response(docs, mask_pii).select("doc_id", "text", "source_name", "score")


@R.add("FLT-19_redacted_queries", "select event_id, case when event_type = 'view' then 'omitted;chars:' || user_id else 'legacy_query_redacted' end as query from events")
def redacted_queries(spark, folder):
    raw = F.when(F.col("event_type") == "view", F.concat(F.lit("omitted;chars:"), F.col("user_id").cast("string"))).otherwise("some text")
    return S.table(spark, folder, "events").select("event_id", filters.redact_query(raw).alias("query"))


@R.add("TOP-08_wide_candidates", """
with r as (select user_id, event_id, value, row_number() over (partition by user_id order by value desc, event_id) as rank from events)
select user_id, count(*) as candidates, min(value) as lowest from r where rank <= 15 group by user_id""")
def wide_candidates(spark, folder):
    df = S.table(spark, folder, "events").select("user_id", "event_id", "value")
    width = max(15, 3 * Settings().retrieval_top_k)
    best = ranking.top_k(df, ["user_id"], [F.desc("value"), F.asc("event_id")], width)
    return best.groupBy("user_id").agg(F.count(F.lit(1)).alias("candidates"), F.min("value").alias("lowest"))


@R.add("AGG-20_event_columns", """
with c as (select unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props']) as col,
  unnest([event_id::varchar, ts::varchar, user_id::varchar, event_type, value::varchar, props]) as raw from events)
select col as "column", count(distinct raw) as unique_count from c group by col""")
def event_columns(spark, folder):
    return profile.column_profile(S.table(spark, folder, "events"), ["event_id"]).select("column", "unique_count")


def _stream(spark, folder, name, schema=None):
    """A table as a stream of its files, be it one file or a folder of them."""
    schema = schema or S.table(spark, folder, name).schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def _drain(stream, mode):
    """Run a bounded stream to its end into files and read them back."""
    spark = stream.sparkSession
    place = scratch_folder(spark)

    def write(df, batch_id):
        df.write.mode("overwrite").parquet(f"{place}/out/batch={batch_id if mode == 'append' else 0}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/ckpt").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{place}/out").drop("batch")


@R.add("STR-08_running_counters", f"with {REQUESTS} select method, endpoint, status::bigint as status, count(*) as requests, round_even(sum(seconds), 4) as seconds from r group by all")
def running_counters(spark, folder):
    events = _stream(spark, folder, "events")
    requests = events.select(
        F.when(F.col("event_type") == "view", "get").otherwise("post").alias("method"), F.concat(F.lit("/"), "event_type").alias("endpoint"),
        F.when(F.col("value") > 60, 500).otherwise(200).alias("status"), (F.col("value") / 1000).alias("seconds"))
    return _drain(counters.running_requests(requests), "complete").withColumn("seconds", rounded("seconds", 4))


@R.add("STR-02_guarded_stream", """
select conv_id::varchar || ':' || turn as trace_id, 1::bigint as finals from conversations where role = 'assistant'""")
def guarded_stream(spark, folder):
    """Answers of all conversations cut into word tokens, released after checking."""
    turns = _stream(spark, folder, "conversations").where("role = 'assistant'")
    words = F.split("text", "(?<= )")
    tokens = turns.select(
        F.concat_ws(":", "conv_id", "turn").alias("trace_id"), F.posexplode(words).alias("seq", "token"), F.size(words).alias("n"), F.col("text").alias("context"),
    ).select("trace_id", F.col("seq").cast("bigint").alias("seq"), "token", (F.col("seq") == F.col("n") - 1).alias("last"),
             F.when(F.col("seq") == 0, F.col("context")).alias("context"))
    released = _drain(guarded.guard_tokens(tokens), "append")
    return released.groupBy("trace_id").agg(F.count_if(F.get_json_object("payload", "$.phase") == "final").alias("finals"))


@R.add("STR-05_cache_stream")
def cache_stream(spark, folder):
    """Embeddings of a label stored as its answers, then looked up once more."""
    rows = _stream(spark, folder, "embeddings").select(F.col("label").cast("string").alias("filter_key"), "vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    both = rows.select("filter_key", "embedding", F.explode(F.array(
        F.struct(F.lit(0.0).alias("stored_at"), F.concat(F.lit("r"), F.col("vec_id").cast("string")).alias("response"), F.col("vec_id").alias("request_id")),
        F.struct(F.lit(1.0).alias("stored_at"), F.lit(None).cast("string").alias("response"), F.col("vec_id").alias("request_id")),
    )).alias("r")).select("filter_key", "r.request_id", "r.stored_at", "embedding", "r.response")
    found = _drain(cache.cached_answers(both), "append")
    return found.groupBy("filter_key").agg(F.count("response").alias("hits"), F.count(F.lit(1)).alias("lookups"))


STORED = "select doc_id, source, sha256(text) as text_sha256 from documents"


def _stored(spark, path):
    rows = spark.read.format("corpus_store").option("path", path).load()
    return rows.select("doc_id", "source", F.sha2("text", 256).alias("text_sha256"))


@R.add("SRC-22_store_batches", STORED)
def store_batches(spark, folder):
    """A write whose tasks fail at some documents leaves nothing; the same batch written twice afterwards is there once."""
    spark.dataSource.register(store.CorpusStore)
    path, docs = f"{scratch_folder(spark)}/store", S.table(spark, folder, "documents")
    broken = docs.withColumn("text", F.when(F.col("doc_id") % 1000 == 0, F.raise_error(F.lit("lost on purpose"))).otherwise(F.col("text")))
    for rows in (broken, docs, docs):
        try:
            rows.write.format("corpus_store").option("path", path).option("batch", "documents").mode("append").save()
        except PySparkException as problem:
            if "lost on purpose" not in str(problem):
                raise
    return _stored(spark, path)


@R.add("STR-01_store_stream", STORED)
def store_stream(spark, folder):
    """A stream into the store, and once more without its checkpoint: the micro-batches are known by their numbers."""
    spark.dataSource.register(store.CorpusStore)
    place = scratch_folder(spark)
    for run in range(2):
        sink = _stream(spark, folder, "documents").writeStream.format("corpus_store").option("path", f"{place}/store").option("batch", "inbox")
        sink.option("checkpointLocation", f"{place}/ckpt{run}").trigger(availableNow=True).start().awaitTermination()
    return _stored(spark, f"{place}/store")


@R.add("STR-06_audit_stream", "select event_id, 'omitted;chars:' || user_id as query from events")
def audit_stream(spark, folder):
    place = scratch_folder(spark)
    entries = _stream(spark, folder, "events").select("event_id", F.concat(F.lit("omitted;chars:"), F.col("user_id").cast("string")).alias("query"))
    counters.audit_sink(entries, f"{place}/out", f"{place}/ckpt", once=True).awaitTermination()
    return spark.read.parquet(f"{place}/out").select("event_id", "query")


def _answered(spark, folder):
    chunks = S.searchable(spark, folder).withColumn("chunk_index", F.lit(0)).withColumn("quality_score", F.lit(100)).withColumn(
        "parent_index", F.lit(None).cast("int")).withColumn("parent_text", F.lit(None).cast("string"))
    docs = S.documents(spark, folder).withColumn("content_hash", F.sha2("text", 256)).drop("text")
    first = lambda question, context: F.when(context.isNotNull(), F.concat(question, F.lit(" [1]")))
    return answer.answer_questions(S.questions(spark, folder), chunks, docs, Settings(embedding_dim=64), complete=first)


@R.add("PLAN_answer_questions")
def answer_questions(spark, folder):
    return _answered(spark, folder).answers


@R.add("STR-04_answer_events", "select item_id as query_id, unnest(range(6)) as seq, unnest(['guardrail', 'sources', 'retrieval_gate', 'guardrail', 'attribution', 'done']) as type from benchmark")
def answer_events(spark, folder):
    return answer.events(_answered(spark, folder)).select("query_id", "seq", "type")
