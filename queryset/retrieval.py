"""Dense, keyword and hybrid retrieval of every question over every document."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions import vectors
from corpusmill.functions.text import TOKEN_PATTERN, rounded, tokens
from corpusmill.operators import answer_cache, catalog, filters, ranking, retrieve, text_index, vector_index
from corpusmill.session import cut_lineage, fan_out, scratch_folder
from corpusmill.sources import tables as S

from .common import Registry, sql_hash_vectors, sql_tokens

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

# Vectors of the embeddings table against the mean vector of each label.
CENTROIDS = """
e as (select vec_id, label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i from embeddings),
c as (select label as q, i, avg(v) as v from e group by all),
en as (select vec_id, label, sqrt(sum(v * v)) as n from e group by all), cn as (select q, sqrt(sum(v * v)) as n from c group by q),
d as (select q, vec_id, any_value(e.label) as label, sum(e.v * c.v) as dot from e join c using (i) group by q, vec_id),
s as (select d.q, d.vec_id, d.label, round(dot / en.n / cn.n, 9) as sim from d join en using (vec_id) join cn on cn.q = d.q)"""


@R.add("VEC-04_dense_topk", f"""
with {CENTROIDS}, r as (select *, row_number() over (partition by q order by sim desc, vec_id) as rank from s)
select q::bigint as query_id, vec_id as chunk_id, round_even(sim, 4) as similarity, rank from r where rank <= 5""")
def dense_topk(spark, folder):
    hits = retrieve.dense_search(S.vectors(spark, folder), S.label_centroids(spark, folder), 5)
    return hits.withColumn("similarity", rounded("similarity", 4))


@R.add("VEC-04_filtered_topk", f"""
with {CENTROIDS}, r as (select *, row_number() over (partition by q order by sim desc, vec_id) as rank from s where label in (1, 3, 5))
select q::bigint as query_id, vec_id as chunk_id, rank from r where rank <= 5""")
def filtered_topk(spark, folder):
    rows = filters.in_scope(S.vectors(spark, folder), filters.SearchScope(document_ids=(1, 3, 5)))
    return retrieve.dense_search(rows, S.label_centroids(spark, folder), 5).drop("similarity")


# Nearest rows of every vector whose id is divisible by 100, among all vectors.
NEAREST = """
v as (select vec_id, embedding::double[] as x from embeddings),
n as (select q.vec_id as query_id, v.vec_id as chunk_id, round(list_inner_product(q.x, v.x) / (sqrt(list_inner_product(q.x, q.x)) * sqrt(list_inner_product(v.x, v.x))), 9) as sim
  from v q, v where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by sim desc, chunk_id) as rank from n)"""


def _indexed(spark, folder, whole=False):
    """Index over all vectors, the asked vectors and what is found: with all lists probed, or with the usual number."""
    rows = S.vectors(spark, folder)
    index = vector_index.build(rows, "chunk_id", "embedding", f"{scratch_folder(spark)}/vector_index")
    asked = rows.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    names = "query_id", "query_vector", 10
    probes = index.lists if whole else vector_index.probes_for(index, rows, "embedding", asked, *names)
    found = vector_index.search(index, rows, "embedding", asked, *names, probes=probes)
    return index, rows, asked, found


@R.add("VEC-04_index_all_lists", f"with {NEAREST} select query_id, chunk_id, round_even(sim, 4) as similarity, rank from r where rank <= 10")
def index_all_lists(spark, folder):
    return _indexed(spark, folder, whole=True)[3].withColumn("similarity", rounded("similarity", 4))


@R.add("VEC-04_index_probed")
def index_probed(spark, folder):
    """Approximate, so without SQL: tests measure its recall, and the next query asks for it."""
    return _indexed(spark, folder)[3].withColumn("similarity", rounded("similarity", 4))


@R.add("VEC-04_index_recall", """
select count(*) as indexed, count(*) filter (vec_id % 100 = 0) as questions, true as reached from embeddings""")
def index_recall(spark, folder):
    """Rows in the index, questions, and whether nine in ten of the exact answers are found."""
    index, rows, asked, found = _indexed(spark, folder)
    exact = retrieve.dense_search(rows, asked, 10)
    measured = vector_index.recall(found, exact, "query_id", "chunk_id")
    stored = index.table(spark).agg(F.count(F.lit(1)).alias("indexed"))
    return stored.join(measured.select("questions", (F.col("recall") >= 0.9).alias("reached")), F.lit(True))


@R.add("VEC-03_cosine", f"with {CENTROIDS} select vec_id, round_even(sim, 4) as similarity from s where q = label")
def cosine(spark, folder):
    means = S.label_centroids(spark, folder).select(F.col("query_id").cast("int").alias("document_id"), "query_vector")
    joined = S.vectors(spark, folder).join(means, "document_id")
    return joined.select(F.col("chunk_id").alias("vec_id"), rounded(vectors.cosine("embedding", "query_vector"), 4).alias("similarity"))


@R.add("VEC-14_hyde_mix", f"""
with {CENTROIDS}, m as (select e.vec_id, 0.65 * e.v / en.n + 0.35 * c.v as x, e.v / en.n as o from e join en using (vec_id) join c on c.q = e.label and c.i = e.i)
select vec_id, round_even(sum(x * o) / sqrt(sum(x * x)) / sqrt(sum(o * o)), 4) as kept from m group by vec_id""")
def hyde_mix(spark, folder):
    means = S.label_centroids(spark, folder).select(F.col("query_id").cast("int").alias("document_id"), "query_vector")
    rows = S.vectors(spark, folder).join(means, "document_id").withColumn("unit", vectors.l2_normalize(F.col("embedding").cast("array<double>")))
    mixed = rows.withColumn("mixed", vectors.mix_hyde("unit", "query_vector"))
    return mixed.select(F.col("chunk_id").alias("vec_id"), rounded(vectors.cosine("mixed", "unit"), 4).alias("kept"))


@R.add("VEC-19_cache_lookup", f"""
with {CENTROIDS}, live as (select * from s where q = label and sim >= 0.2 and vec_id % 3600 <= 1800)
select q::bigint as query_id, max_by(vec_id, -(vec_id % 3600)) as response from live group by q""")
def cache_lookup(spark, folder):
    """Vectors as cached answers of their label, stored as many seconds ago as their id says."""
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    stored = F.timestamp_seconds(F.unix_timestamp(now) - F.col("chunk_id") % 3600)
    cache = S.vectors(spark, folder).select(
        F.col("document_id").cast("string").alias("filter_key"), "embedding", F.col("chunk_id").alias("response"), stored.alias("stored_at"))
    lookups = S.label_centroids(spark, folder).select(
        F.col("query_id").alias("lookup_id"), F.col("query_id").cast("string").alias("filter_key"), F.col("query_vector").alias("embedding"))
    return answer_cache.newest_answers(cache, lookups, now, 1800, 0.2).withColumnRenamed("lookup_id", "query_id")


# Hash-embedded questions against hash-embedded documents.
TEXT = f"""
{sql_hash_vectors('dv', 'documents', 'doc_id', 'text')},
{sql_hash_vectors('qv', 'benchmark', 'item_id', 'text')},
s as (select q.id as q, d.id as c, round(sum(q.x * d.x), 9) as sim from qv q join dv d using (slot) group by all),
dr as (select *, row_number() over (partition by q order by sim desc, c) as rank from s)"""
DT = f"dt as (select doc_id as c, {sql_tokens('text')} as ts from documents)"
RAW_TERMS = f"qt as (select q, term, count(*) as qtf from (select item_id as q, unnest({sql_tokens('text')}) as term from benchmark) group by all)"
# No term of the tables has a linked term, so normalizing keeps the distinct tokens.
FIRST_TERMS = f"""
qw as (select item_id as q, {sql_tokens('text')} as ts from benchmark),
qo as (select q, term, min(p) as p from (select q, unnest(ts) as term, unnest(range(len(ts))) as p from qw) group by all),
qn as (select *, row_number() over (partition by q order by p) as pos from qo),
qt as (select q, term, 1 as qtf from qn)"""


def bm25_sql(name: str, pairs: str) -> str:
    """CTEs giving {name}(q, c, bm25, overlap) for candidate pairs (q, c); needs dt and qt."""
    return f"""
{name}_p as (select p.q, p.c, dt.ts from ({pairs}) p join dt using (c)),
{name}_n as (select q, count(*) as n, avg(len(ts)) as avgdl from {name}_p group by q),
{name}_v as (select q, term, count(*) as df from (select q, unnest(list_distinct(ts)) as term from {name}_p) group by all),
{name}_i as (select v.q, term, ln(n - df + 0.5) - ln(df + 0.5) as idf from {name}_v v join {name}_n using (q)),
{name}_m as (select q, avg(idf) as mean_idf from {name}_i group by q),
{name}_f as (select p.q, p.c, term, len(list_filter(ts, lambda x: x = term)) as tf, len(ts) as dl, qtf from {name}_p p join qt on qt.q = p.q where list_contains(ts, term)),
{name}_s as (select f.q, f.c, sum(qtf * case when idf < 0 then 0.25 * mean_idf else idf end * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as raw, count(*) as shared
  from {name}_f f join {name}_i i on i.q = f.q and i.term = f.term join {name}_m m on m.q = f.q join {name}_n n on n.q = f.q group by all),
{name}_t as (select q, count(*) as terms from qt group by q),
{name} as (select p.q, p.c, case when n < 2 then 0 else coalesce(round(raw, 9), 0) end as bm25, case when n < 2 then 0 else coalesce(shared / terms, 0) end as overlap
  from {name}_p p join {name}_n using (q) left join {name}_s s on s.q = p.q and s.c = p.c left join {name}_t t on t.q = p.q)"""


def fused_sql(lists: str, k: int = 5) -> str:
    """Fusion of the rows (q, c, part) of ``lists``."""
    return f"""
parts as ({lists}), raw as (select q, c, sum(part) as raw from parts group by all),
rr as (select *, row_number() over (partition by q order by raw desc, c) as rank, max(raw) over (partition by q) as top from raw)
select q as query_id, c as chunk_id, rank, round_even(raw, 6) as rrf_score, round_even(raw / top, 4) as combined_score from rr where rank <= {k}"""


@R.add("VEC-04_text_topk", f"with {TEXT} select q as query_id, c as chunk_id, round_even(sim, 4) as similarity, rank from dr where rank <= 10")
def text_topk(spark, folder):
    hits = retrieve.dense_search(S.searchable(spark, folder), S.embedded_questions(spark, folder), 10)
    return hits.withColumn("similarity", rounded("similarity", 4))


def keywords_sql(first: str = "") -> str:
    return f"""
{FIRST_TERMS}, kw as (select q, term from qn {first}), qc as (select q, count(*) as need from kw group by q),
hit as (select kw.q, d.doc_id as c, sum((strpos(lower(d.text), kw.term) > 0)::int) as matches,
  sum(list_contains(dt.ts, kw.term)::int) as present,
  round(sum(len(list_filter(dt.ts, lambda x: x = kw.term)))::double / greatest(len(dt.ts), 1), 9) as density
  from kw, documents d join dt on dt.c = d.doc_id group by kw.q, d.doc_id, len(dt.ts)),
ks as (select *, row_number() over (partition by q order by matches desc, c) as kr from hit where matches > 0),
al as (select hit.*, row_number() over (partition by hit.q order by density desc, hit.c) as ar from hit join qc using (q) where present >= need),
cand as (select q, c, max(matches)::double as raw_matches from (select q, c, matches from ks where kr <= 30 union all select q, c, matches from al where ar <= 30) group by all)"""


KEYWORDS, FIRST_KEYWORDS = keywords_sql(), keywords_sql("where pos <= 8")


@R.add("VEC-06_keyword_candidates", f"with {DT}, {FIRST_KEYWORDS} select q as query_id, c as chunk_id, raw_matches from cand")
def keyword_candidates(spark, folder):
    return retrieve.keyword_search(S.searchable(spark, folder), S.embedded_questions(spark, folder), terms=8)


@R.add("VEC-05_all_terms", f"with {DT}, {FIRST_KEYWORDS} select q as query_id, c as chunk_id, density, ar as rank from al where ar <= 30")
def all_terms(spark, folder):
    return retrieve.all_terms_search(S.searchable(spark, folder), S.questions(spark, folder), terms=8)


# Covers of the first eight words: for each occurrence the latest place of every word gives the shortest stretch that ends
# there; one that begins where an earlier one began holds it and is no cover.
COVERS = """
pl as (select doc_id as c, unnest(ws) as term, unnest(range(len(ws))) as p
  from (select doc_id, regexp_extract_all(lower(text), '%s') as ws from documents)),
hw as (select kw.q, c, term, p from kw join pl using (term)),
al as (select q, c from hw join qc using (q) group by q, c, need having count(distinct term) = need),
oc as (select hw.* from hw join al using (q, c)),
la as (select a.q, a.c, a.p as e, b.term, max(b.p) as last from oc a join oc b on a.q = b.q and a.c = b.c and b.p <= a.p group by all),
st as (select q, c, e, min(last) as s from la join qc using (q) group by q, c, e, need having count(*) = need),
cv as (select q, c, s, min(e) as e from st group by all),
cn as (select cv.q, cv.c, cv.s, cv.e, count(*) as inside from cv join oc on oc.q = cv.q and oc.c = cv.c and oc.p between cv.s and cv.e group by all),
cr as (select q, c, round(sum(0.1::double / (1 + e - s + 1 - inside)), 9) as score from cn group by q, c),
cd as (select *, row_number() over (partition by q order by score desc, c) as rank from cr)""" % TOKEN_PATTERN


def _text_index(spark, folder, parts=True):
    documents = S.documents(spark, folder).select(F.col("document_id").alias("chunk_id"), "text")
    return text_index.build(documents, "chunk_id", "text", f"{scratch_folder(spark)}/text_index", parts=parts)


@R.add("VEC-05_cover_density", f"""
with {FIRST_TERMS}, kw as (select q, term from qn where pos <= 8), qc as (select q, count(*) as need from kw group by q), {COVERS}
select q as query_id, c as chunk_id, score, rank from cd where rank <= 30""")
def cover_density(spark, folder):
    return text_index.cover_search(_text_index(spark, folder, parts=False), retrieve._keywords(S.questions(spark, folder), 8), "query_id", "t")


@R.add("VEC-06_indexed_candidates", f"""
with {FIRST_TERMS}, kw as (select q, term from qn where pos <= 8), qc as (select q, count(*) as need from kw group by q), {COVERS},
kc as (select kw.q, d.doc_id as c, count(*) as matches from kw, documents d where strpos(lower(d.text), kw.term) > 0 group by all),
kr as (select *, row_number() over (partition by q order by matches desc, c) as rank from kc)
select q as query_id, c as chunk_id, max(matches)::double as raw_matches from (
  select q, c, matches from kr where rank <= 30 union all select q, c, need from cd join qc using (q) where rank <= 30) group by all""")
def indexed_candidates(spark, folder):
    """Best documents by words contained, and by cover density of those that hold all words."""
    index, asked = _text_index(spark, folder), retrieve._keywords(S.questions(spark, folder), 8)
    return text_index.keyword_candidates(index, asked, "query_id", "t").withColumnRenamed("n", "raw_matches")


@R.add("STR-07_distinct_embeddings", f"""
with t as (select distinct text, min(doc_id) over (partition by text) as first_id from documents),
{sql_hash_vectors('v', 't', 'first_id', 'text')}
select doc_id, round_even(sum(x), 6) as total from documents join t using (text) join v on v.id = first_id group by doc_id""")
def distinct_embeddings(spark, folder):
    embedded = vectors.embed_distinct(S.documents(spark, folder), "text", lambda c: vectors.hash_embedding(c, 64))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return embedded.select(F.col("document_id").alias("doc_id"), rounded(total, 6).alias("total"))


@R.add("DML-07_cache_scope", "select event_id, (event_id % 5)::varchar || ':' || sha256(event_type) as scope from events")
def cache_scope(spark, folder):
    return S.table(spark, folder, "events").select("event_id", catalog.cache_scope(F.col("event_type"), F.col("event_id") % 5).alias("scope"))


@R.add("JOIN-06_term_candidates", f"""
with {DT}, {FIRST_TERMS}, t as (select c, unnest(list_distinct(ts)) as term from dt)
select q as query_id, count(distinct c) as candidates from t join qt using (term) group by q""")
def term_candidates(spark, folder):
    return retrieve.term_candidates(S.searchable(spark, folder), S.questions(spark, folder)).groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates"))


@R.add("VEC-07_bm25_candidates", f"""
with {TEXT}, {DT}, {RAW_TERMS}, {bm25_sql('b', 'select q, c from dr where rank <= 30')}
select q as query_id, c as chunk_id, round_even(bm25, 4) as bm25_score, round_even(overlap, 4) as lexical_overlap,
  row_number() over (partition by q order by bm25 desc, overlap desc, c) as rank from b""")
def bm25_candidates(spark, folder):
    chunks = S.searchable(spark, folder)
    dense = cut_lineage(retrieve.dense_search(chunks, S.embedded_questions(spark, folder), 30))
    asked = S.questions(spark, folder).select("query_id", tokens("query_text").alias("terms"))
    scored = retrieve.with_bm25(retrieve.with_tokens(dense, chunks), asked)
    return retrieve._lexical_ranks(scored).withColumn("bm25_score", rounded("bm25_score", 4)).withColumn("lexical_overlap", rounded("lexical_overlap", 4))


@R.add("VEC-08_rank_fusion", f"""
with {TEXT}, {DT}, {KEYWORDS}, kl as (select q, c, row_number() over (partition by q order by raw_matches desc, c) as rank from cand),
{fused_sql('select q, c, 1.0 / (60 + rank) as part from dr where rank <= 20 union all select q, c, 1.2 / (60 + rank) from kl', 10)}""")
def rank_fusion(spark, folder):
    chunks, asked = S.searchable(spark, folder), S.embedded_questions(spark, folder)
    dense = retrieve.dense_search(chunks, asked, 20)
    keyword = ranking.top_k(retrieve.keyword_search(chunks, asked), ["query_id"], [F.desc("raw_matches"), F.asc("chunk_id")], 60)
    return ranking.fuse_ranks([(dense, 1.0), (keyword, 1.2)], "query_id", "chunk_id", 10)


@R.add("VEC-09_hybrid_weighted", f"""
with {TEXT}, {DT}, {KEYWORDS}, {bm25_sql('b', 'select q, c from cand')},
sp as (select b.q, b.c, row_number() over (partition by b.q order by bm25 desc, overlap desc, raw_matches desc, b.c) as rank from b join cand using (q, c)),
w as (select item_id as q, case when contains(text, '"') or contains(text, '''') or regexp_matches(text, '제[0-9]+조|[A-Z0-9_-]{{4,}}') then 0.8 when n >= 6 then 1.3 else 1.0 end as dw,
  case when contains(text, '"') or contains(text, '''') or regexp_matches(text, '제[0-9]+조|[A-Z0-9_-]{{4,}}') then 1.4 when n >= 6 then 0.7 else 1.0 end as sw
  from benchmark join (select q as item_id, count(*) as n from qt group by q) using (item_id)),
parts as (select q, c, dw / (60 + rank) as part from dr join w using (q) where rank <= 20 union all select q, c, sw / (60 + rank) from sp join w using (q)),
raw as (select q, c, sum(part) as raw from parts group by all),
rr as (select *, row_number() over (partition by q order by raw desc, c) as rank from raw)
select rr.q as query_id, rr.c as chunk_id, rr.rank, round_even(raw, 4) as rrf_score, case when dr.rank <= 20 then round_even(sim, 4) else 0.5 end as score
from rr join dr on dr.q = rr.q and dr.c = rr.c where rr.rank <= 5""")
def hybrid_weighted(spark, folder):
    return retrieve.hybrid_weighted(S.searchable(spark, folder), S.embedded_questions(spark, folder), 5).withColumn("score", rounded("score", 4))


@R.add("VEC-10_hybrid_terms", f"""
with {TEXT}, {DT}, {FIRST_TERMS}, t as (select c, unnest(list_distinct(ts)) as term from dt),
pairs as (select q, c from dr where rank <= 20 union select q, c from t join qt using (term)), {bm25_sql('b', 'select q, c from pairs')},
lx as (select q, c, row_number() over (partition by q order by bm25 desc, overlap desc, c) as rank from b where overlap > 0),
{fused_sql('select q, c, 1.0 / (60 + rank) as part from dr where rank <= 20 union all select q, c, 1.2 / (60 + rank) from lx')}""")
def hybrid_terms(spark, folder):
    return retrieve.hybrid_terms(S.searchable(spark, folder), S.embedded_questions(spark, folder), 5)


@R.add("VEC-11_hybrid_exhaustive", f"""
with {TEXT}, {DT}, {RAW_TERMS}, g as (select count(*) as n, avg(len(ts)) as avgdl from dt),
v as (select term, count(*) as df from (select unnest(list_distinct(ts)) as term from dt) group by all),
i as (select term, ln(n - df + 0.5) - ln(df + 0.5) as idf from v, g), mi as (select avg(idf) as mean_idf from i),
tf as (select c, term, count(*) as tf, any_value(dl) as dl from (select c, unnest(ts) as term, len(ts) as dl from dt) group by all),
b as (select q, c, round(sum(qtf * case when idf < 0 then 0.25 * mean_idf else idf end * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) as bm25
  from qt join tf using (term) join i using (term), g, mi group by all),
lx as (select q, c, row_number() over (partition by q order by bm25 desc, c) as rank from b),
{fused_sql('select q, c, 1.0 / (60 + rank) as part from dr union all select q, c, 1.2 / (60 + rank) from lx')}""")
def hybrid_exhaustive(spark, folder):
    return retrieve.hybrid_exhaustive(S.searchable(spark, folder), S.embedded_questions(spark, folder), 5)


@R.add("VEC-12_hybrid_scaled", f"""
with {TEXT}, {DT}, {RAW_TERMS}, {bm25_sql('b', 'select q, c from dr where rank <= 15')},
mm as (select *, min(bm25) over (partition by q) as lo, max(bm25) over (partition by q) as hi from b),
z as (select mm.q, mm.c, round_even(round_even(sim, 4) * 0.7 + (0.7 * case when hi > lo then (bm25 - lo) / (hi - lo) else 0 end + 0.3 * overlap) * 0.3, 4) as combined_score
  from mm join dr on dr.q = mm.q and dr.c = mm.c)
select q as query_id, c as chunk_id, combined_score, rank from (select *, row_number() over (partition by q order by combined_score desc, c) as rank from z) where rank <= 5""")
def hybrid_scaled(spark, folder):
    return retrieve.hybrid_scaled(S.searchable(spark, folder), S.embedded_questions(spark, folder), 5).select("query_id", "chunk_id", "combined_score", "rank")


@R.add("VEC-13_multi_query", rf"""
with pt as (select item_id, unnest(list_filter(string_split_regex(text, '[.?!]\s+'), lambda x: length(trim(x)) > 10)) as body,
  unnest(range(len(list_filter(string_split_regex(text, '[.?!]\s+'), lambda x: length(trim(x)) > 10)))) as part from benchmark),
pk as (select item_id || ':' || part as id, trim(body, ' ' || chr(10)) as body from pt),
{sql_hash_vectors('dv', 'documents', 'doc_id', 'text')}, {sql_hash_vectors('qv', 'pk', 'id', 'body')},
s as (select q.id as p, d.id as c, round(sum(q.x * d.x), 9) as sim from qv q join dv d using (slot) group by all),
dr as (select *, row_number() over (partition by p order by sim desc, c) as rank from s),
{fused_sql("select split_part(p, ':', 1)::bigint as q, c, 1.0 / (60 + rank) as part from dr where rank <= 15")}""")
def multi_query(spark, folder):
    parts = retrieve.split_sentences(S.questions(spark, folder))
    asked = parts.select(F.concat_ws(":", F.col("query_id").cast("string"), F.col("part").cast("string")).alias("query_id"),
                         vectors.hash_embedding("body", 64).alias("query_vector"))
    hits = retrieve.dense_search(S.searchable(spark, folder), asked, 15)
    split = F.split("query_id", ":")
    return retrieve.fuse_subqueries(hits.select(split[0].cast("bigint").alias("query_id"), split[1].alias("part"), "chunk_id", "rank"), 5)


RERANK = f"""
{TEXT}, h as (select dr.*, text from dr join documents on doc_id = c where rank <= 15),
ql as (select item_id as q, lower(text) as qt, list_filter(string_split_regex(lower(text), '\\s+'), lambda t: length(t) >= 2) as terms from benchmark),
z as (select h.q, c, round_even((case when sim = 0 then 0.5 else sim end) * 0.5 + case when len(terms) > 0 then len(list_filter(terms, lambda t: contains(lower(text), t))) / len(terms) else 0 end * 0.3
  + case when contains(lower(text), qt) then 0.2 else 0 end + 0.1, 4) as rerank_score from h join ql using (q)),
zr as (select *, row_number() over (partition by q order by rerank_score desc, c) as rank from z)"""


def text_hits(spark, folder, k=15):
    """Dense hits with their question and document."""
    hits = cut_lineage(retrieve.dense_search(S.searchable(spark, folder), S.embedded_questions(spark, folder), k))
    docs = S.documents(spark, folder).select(F.col("document_id").alias("chunk_id"), "document_id", "source_name", F.col("text").alias("content"))
    return retrieve.with_chunks(hits, docs).join(S.questions(spark, folder), "query_id").withColumn("score", F.col("similarity")).withColumn(
        "quality_score", F.lit(100)).withColumn("chunk_index", F.lit(0))


@R.add("VEC-15_rerank", f"with {RERANK} select q as query_id, c as chunk_id, rerank_score, rank from zr where rank <= 5")
def rerank(spark, folder):
    return retrieve.rerank(text_hits(spark, folder), 5).select("query_id", "chunk_id", "rerank_score", "rank")


@R.add("VEC-16_model_rerank", f"""
with {TEXT}, h as (select dr.*, length(text) as n from dr join documents on doc_id = c where rank <= 15)
select q as query_id, c as chunk_id, rank from (select *, row_number() over (partition by q order by n::double desc, c) as rank from (select q, c, n from h)) where rank <= 5""")
def model_rerank(spark, folder):
    """The slot of a cross-encoder's score, here filled with the text length."""
    return retrieve.rerank(text_hits(spark, folder), 5, model_score=F.length("content").cast("double")).select("query_id", "chunk_id", "rank")


@R.add("VEC-17_parent_expansion", f"""
with {CENTROIDS}, r as (select *, row_number() over (partition by q order by sim desc, vec_id) as rank from s),
p as (select *, row_number() over (partition by q, label, vec_id % 4 order by rank) as n from r where rank <= 20)
select q::bigint as query_id, vec_id as chunk_id, rank, 'parent ' || (vec_id % 4) as content from p where n = 1""")
def parent_expansion(spark, folder):
    hits = retrieve.dense_search(S.vectors(spark, folder), S.label_centroids(spark, folder), 20)
    joined = hits.join(S.vectors(spark, folder).select("chunk_id", "document_id"), "chunk_id")
    number = F.col("chunk_id") % 4
    family = joined.select("*", number.alias("parent_index"), F.concat(F.lit("parent "), number.cast("string")).alias("parent_text"), F.lit("child").alias("content"))
    return retrieve.expand_parents(family).select("query_id", "chunk_id", "rank", "content")


@R.add("VEC-18_score_precedence", "select event_id, coalesce(case when value > 60 then value end, case when user_id % 2 = 0 then user_id / 100 end, case when event_type = 'view' then 1.0 end, 0.0) as score from events")
def score_precedence(spark, folder):
    df = S.table(spark, folder, "events").select(
        "event_id", F.when(F.col("value") > 60, F.col("value")).alias("combined_score"),
        F.when(F.col("user_id") % 2 == 0, F.col("user_id") / 100).alias("rrf_score"), F.when(F.col("event_type") == "view", 1.0).alias("score"))
    return df.select("event_id", retrieve.hit_score(df).alias("score"))


@R.add("WIN-01_list_rank", f"with {CENTROIDS} select q::bigint as query_id, vec_id as chunk_id, row_number() over (partition by q order by sim desc, vec_id) as rank from s qualify rank <= 3")
def list_rank(spark, folder):
    return retrieve.dense_search(S.vectors(spark, folder), S.label_centroids(spark, folder), 3).drop("similarity")


@R.add("WIN-02_first_known", "select user_id, arg_min(value, event_id) filter (event_type = 'purchase') as first_purchase from events group by user_id having first_purchase is not null")
def first_known(spark, folder):
    known = F.when(F.col("event_type") == "purchase", F.col("value"))
    return retrieve.first_known(S.table(spark, folder, "events"), "user_id", known, "event_id", "first_purchase")


@R.add("WIN-04_min_max", f"""
with {CENTROIDS}, r as (select *, row_number() over (partition by q order by sim desc, vec_id) as rank from s),
t as (select * from r where rank <= 10)
select q::bigint as query_id, vec_id as chunk_id, round_even((sim - min(sim) over (partition by q)) / (max(sim) over (partition by q) - min(sim) over (partition by q)), 4) as scaled from t""")
def min_max(spark, folder):
    hits = retrieve.dense_search(S.vectors(spark, folder), S.label_centroids(spark, folder), 10)
    return hits.select("query_id", "chunk_id", rounded(ranking.min_max(F.col("similarity"), "query_id"), 4).alias("scaled"))


@R.add("WIN-05_u_shape", f"""
with {CENTROIDS}, r as (select *, row_number() over (partition by q order by sim desc, vec_id) as rank from s)
select q::bigint as query_id, rank, row_number() over (partition by q order by case when rank = 1 then 0 when rank % 2 = 0 then 1 else 2 end, case when rank % 2 = 0 then -rank else rank end) as position
from r where rank <= 7""")
def u_shape(spark, folder):
    hits = retrieve.dense_search(S.vectors(spark, folder), S.label_centroids(spark, folder), 7)
    return retrieve.u_shaped(hits).select("query_id", "rank", "position")


@R.add("TXT-20_prompt_context", f"""
with {TEXT}, h as (select dr.*, text, source from dr join documents on doc_id = c where rank <= 5),
p as (select *, row_number() over (partition by q order by case when rank = 1 then 0 when rank % 2 = 0 then 1 else 2 end, case when rank % 2 = 0 then -rank else rank end) as pos from h)
select q as query_id, sha256(string_agg('[' || rank || '] source=' || source || ' chunk=0' || chr(10) || text, chr(10) || chr(10) order by pos)) as context_hash from p group by q""")
def prompt_context(spark, folder):
    return retrieve.build_context(text_hits(spark, folder, 5)).select("query_id", F.sha2("context", 256).alias("context_hash"))


@R.add("JOIN-01_hits_with_documents", f"with {TEXT} select q as query_id, c as chunk_id, source as source_name, lang as project_name from dr join documents on doc_id = c where rank <= 3")
def hits_with_documents(spark, folder):
    hits = retrieve.dense_search(S.searchable(spark, folder), S.embedded_questions(spark, folder), 3)
    named = retrieve.with_documents(hits, S.documents(spark, folder), ["source_name", "project_name"])
    return named.select("query_id", "chunk_id", "source_name", "project_name")


@R.add("FLT-14_live_documents", f"""
with {TEXT} select q as query_id, c as document_id, source as source_name, sha256(text) as content_hash from dr join documents on doc_id = c where rank <= 10 and lang = 'en'""")
def live_documents(spark, folder):
    hits = retrieve.dense_search(S.searchable(spark, folder), S.embedded_questions(spark, folder), 10).select(
        "query_id", F.col("chunk_id").alias("document_id"), F.lit("stale").alias("source_name"))
    docs = S.documents(spark, folder).withColumn("content_hash", F.sha2("text", 256)).drop("text")
    return retrieve.bind_live_documents(hits, docs, "en")


@R.add("JOIN-04_live_semi_join", "select doc_id as document_id, quality from labels where doc_id in (select doc_id from documents where lang <> 'fr')")
def live_semi_join(spark, folder):
    children = S.table(spark, folder, "labels").select(F.col("doc_id").alias("document_id"), "quality")
    return catalog.drop_orphans(children, S.documents(spark, folder).where("project_name <> 'fr'"))


@R.add("JOIN-07_merged_lists", f"""
with {TEXT}, {DT}, {KEYWORDS}, dd as (select q, c, rank from dr where rank <= 20)
select coalesce(d.q, k.q) as query_id, coalesce(d.c, k.c) as chunk_id, coalesce(d.rank, 0) as dense_rank, coalesce(k.raw_matches, 0.0) as raw_matches
from dd d full join cand k on d.q = k.q and d.c = k.c""")
def merged_lists(spark, folder):
    chunks, asked = S.searchable(spark, folder), S.embedded_questions(spark, folder)
    return retrieve.merge_candidates(retrieve.dense_search(chunks, asked, 20), retrieve.keyword_search(chunks, asked))


@R.add("SET-01_candidate_union", f"""
with {TEXT}, {DT}, {KEYWORDS} select q as query_id, count(*) as candidates from (select q, c from dr where rank <= 20 union select q, c from cand) group by q""")
def candidate_union(spark, folder):
    chunks, asked = S.searchable(spark, folder), S.embedded_questions(spark, folder)
    both = retrieve.merge_candidates(retrieve.dense_search(chunks, asked, 20), retrieve.keyword_search(chunks, asked))
    return both.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates"))


@R.add("FLT-12_document_search", "select doc_id from documents where source ilike '%src1%' or text ilike '%tion%ly%'")
def document_search(spark, folder):
    docs = S.documents(spark, folder)
    named = filters.search_documents(docs, "src1", content="text").select("document_id")
    worded = filters.search_documents(docs, "tion%ly", content="text").select("document_id")
    return named.union(worded).distinct().withColumnRenamed("document_id", "doc_id")
