"""Aggregate plans, table predicates and structural quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.text import rounded
from corpusmill.operators import filters, profile
from corpusmill.plans import aggregate as A
from corpusmill.sources.tables import table
from corpusmill.session import fan_out

from .common import Registry, by_id, sql_number

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def lines(spark, folder):
    return table(spark, folder, "lineitem").select(*LINE_COLUMNS)


def run(df, plan):
    checked = A.validate_plan(plan, df.columns, [plan.column] if plan.column else [], None)
    result = A.run_plan(df, checked)
    return result if plan.metric == "count" else result.withColumn("value", rounded("value", 2))


def aggregate_query(name, metric, column=None, groups=(), flt=(), limit=None, order="desc"):
    plan = A.AggregatePlan(metric, column, tuple(groups), tuple(flt), limit, order)
    picked = ", ".join(groups)
    value = "count(*)" if metric == "count" else f"round_even({metric}({sql_number(f'{column}::varchar')}), 2)"
    where = " and ".join(sql_predicate(f) for f in flt)
    sql = f"select {picked + ', ' if groups else ''}{value} as value from lineitem"
    if where:
        sql += f" where {where}"
    if groups:
        raw = "count(*)" if metric == "count" else f"{metric}({sql_number(f'{column}::varchar')})"
        sql += f" group by {picked} order by {raw} {order} nulls last, {picked}"
    sql = f"select {picked + ', ' if groups else ''}value from ({sql} {f'limit {limit}' if limit else ''})"
    R.add(name, sql)(lambda spark, folder: run(lines(spark, folder), plan))


def sql_predicate(f):
    text = f"{f.column}::varchar"
    if f.operator in ("is_null", "not_null"):
        return f"nullif(trim({text}), '') is {'not ' if f.operator == 'not_null' else ''}null"
    if f.operator in ("gt", "gte", "lt", "lte"):
        sign = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<="}[f.operator]
        return f"{sql_number(text)} {sign} {float(f.value)}"
    if f.operator == "contains":
        return f"contains(lower({text}), lower('{f.value}'))"
    return f"lower({text}) {'=' if f.operator == 'eq' else '<>'} lower('{f.value}')"


flt = A.Filter
aggregate_query("AGG-01_count", "count")
aggregate_query("AGG-02_sum", "sum", "l_extendedprice")
aggregate_query("AGG-03_avg", "avg", "l_quantity", ["l_returnflag"])
aggregate_query("AGG-04_min", "min", "l_tax", ["l_linestatus"], order="asc")
aggregate_query("AGG-05_max", "max", "l_extendedprice", ["l_returnflag", "l_linestatus"])
aggregate_query("AGG-06_grouped_sum", "sum", "l_quantity", ["l_returnflag"], [flt("l_discount", "gt", 0.05)])
aggregate_query("AGG-06_four_groups", "count", None, ["l_returnflag", "l_linestatus", "l_linenumber", "l_tax"], order="asc")
aggregate_query("FLT-01_eq", "count", None, ["l_linestatus"], [flt("l_returnflag", "eq", "a")])
aggregate_query("FLT-01_ne", "count", None, ["l_returnflag"], [flt("l_linestatus", "ne", "F")])
aggregate_query("FLT-02_gt", "count", None, ["l_returnflag"], [flt("l_quantity", "gt", 24)])
aggregate_query("FLT-02_gte", "count", None, ["l_returnflag"], [flt("l_quantity", "gte", 24)])
aggregate_query("FLT-02_lt", "count", None, ["l_returnflag"], [flt("l_quantity", "lt", "10")])
aggregate_query("FLT-02_lte", "count", None, ["l_returnflag"], [flt("l_quantity", "lte", "10")])
aggregate_query("FLT-03_contains", "count", None, ["l_returnflag"], [flt("l_orderkey", "contains", "99")])
aggregate_query("FLT-04_is_null", "count", None, [], [flt("l_returnflag", "is_null")])
aggregate_query("FLT-04_not_null", "count", None, ["l_linestatus"], [flt("l_returnflag", "not_null")])
aggregate_query("FLT-05_conjunction", "avg", "l_extendedprice", ["l_linenumber"], [
    flt("l_quantity", "gte", 10), flt("l_quantity", "lt", 40), flt("l_returnflag", "ne", "R"), flt("l_discount", "lte", 0.08)])


@R.add("AGG-10_numeric_columns", " union all ".join(
    f"select '{c}' as \"column\", count({sql_number(f'{c}::varchar')}) as numeric_count from lineitem" for c in LINE_COLUMNS))
def numeric_columns(spark, folder):
    return A.numeric_columns(lines(spark, folder))


@R.add("AGG-08_planned_question", """
select l_returnflag, value from (
  select l_returnflag, round_even(avg(l_quantity), 2) as value from lineitem group by l_returnflag
  order by avg(l_quantity) desc, l_returnflag limit 20)""")
def planned_question(spark, folder):
    question = "average l_quantity per l_returnflag group"
    planner = lambda _q, _c, _n: {"metric": "avg", "column": "l_quantity", "group_by": ["l_returnflag"],
                                  "filters": [], "limit": 20, "order": "desc"}
    answer = A.answer_question(lines(spark, folder), question, planner)
    return answer.results.withColumn("value", rounded("value", 2))


@R.add("AGG-09_rule_planner", "select round_even(sum(l_extendedprice), 2) as value from lineitem")
def rule_planner(spark, folder):
    answer = A.answer_question(lines(spark, folder), "sum of l_extendedprice")
    return answer.results.withColumn("value", rounded("value", 2))


ASKED, ASKED_SQL = by_id("doc_id", ["", " 학교별 평균을 알려줘", " the total", " subtotal", " 개수는?", " MAX value", " minimal", " 최고 점수"])


@R.add("AGG-11_route_intent", rf"""
with d as (select doc_id, text || {ASKED_SQL} as text from documents)
select doc_id, regexp_matches(lower(text), '평균|합계|총액|총합|합산|집계|통계|계산|건수|개수|수량|비율|최소|최저|최대|최고')
  or regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_])(average|avg|sum|total|count|aggregate|statistics|minimum|maximum|min|max)($|[^\p{{L}}\p{{N}}_])')
  as aggregates from d""")
def route_intent(spark, folder):
    asked = table(spark, folder, "documents").select("doc_id", F.concat("text", ASKED()).alias("text"))
    return asked.select("doc_id", A.wants_aggregate("text").alias("aggregates"))


ENDING, ENDING_SQL = by_id("page_id", ["", ".csv", ".XLSX", ".csv.gz", ".html"])
MIME, MIME_SQL = by_id("page_id", ["", "text/html", "TEXT/CSV"])


@R.add("AGG-12_table_source", rf"""
with p as (select page_id, url || {ENDING_SQL} as name, nullif({MIME_SQL}, '') as mime from pages)
select page_id, lower(regexp_extract(name, '\.([^.]*)$', 1)) in ('csv', 'tsv', 'xlsx', 'xls') or coalesce(lower(mime) = 'text/csv', false) as tabular from p""")
def table_source(spark, folder):
    named = table(spark, folder, "pages").select("page_id", F.concat("url", ENDING()).alias("name"), F.nullif(MIME(), F.lit("")).alias("mime"))
    return named.select("page_id", A.is_table_source(F.col("name"), F.col("mime")).alias("tabular"))


@R.add("TOP-02_value_order", """
select o_custkey::varchar as o_custkey, value from (
  select o_custkey, round_even(sum(o_totalprice), 2) as value from orders group by o_custkey
  order by sum(o_totalprice) asc nulls last, o_custkey::varchar limit 10)""")
def value_order(spark, folder):
    df = A.as_text_table(table(spark, folder, "orders"), ["o_custkey", "o_totalprice"])
    return run(df, A.AggregatePlan("sum", "o_totalprice", ("o_custkey",), (), 10, "asc"))


PROFILE_DOMAINS = """
  case when sampled > 0 and d >= sampled * 0.7 then '날짜 (YYYY-MM-DD)' when sampled > 0 and p >= sampled * 0.7 then '연락처 (전화번호)'
       when sampled > 0 and e >= sampled * 0.7 then '이메일' when sampled > 0 and m = sampled then '숫자형 도메인' else '일반 텍스트' end"""
SHAPE_SQL = {
    "d": r"regexp_matches(v, '^(\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{4}\.\d{2}\.\d{2})$')",
    "p": r"regexp_matches(v, '^01[016789]-?\d{3,4}-?\d{4}$')",
    "e": r"regexp_matches(v, '^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$')",
    "m": r"regexp_matches(v, '^(\d+\.?\d*|\.\d+)$')",
}


def profile_sql(cells: str, sample: int | None = None) -> str:
    counts = ", ".join(f"count(*) filter ({test}) as {name}" for name, test in SHAPE_SQL.items())
    return f"""
with cells as ({cells}),
good as (select *, trim(raw) as v from cells where raw is not null and trim(raw) not in ('', 'null', 'none', 'nan', '-')),
ranked as (select *, row_number() over (partition by col order by pos) as rn from good),
sampled as (select col, count(*) as sampled, {counts} from ranked {f'where rn <= {sample}' if sample else ''} group by col),
domains as (select col, {PROFILE_DOMAINS} as domain from sampled),
fit as (select g.col, g.v, case
    when domain like '날짜%' then {SHAPE_SQL['d']} and try_cast(translate(v, '/.', '--') as date) is not null
    when domain like '연락처%' then {SHAPE_SQL['p']} when domain = '이메일' then {SHAPE_SQL['e']}
    when domain = '숫자형 도메인' then {SHAPE_SQL['m']} else true end as ok
  from good g join domains using (col)),
nulls as (select col, count(*) as total, count(*) filter (raw is null or trim(raw) = '' or lower(raw) in ('null', 'none', 'nan', '-')) as n
  from cells group by col),
uniq as (select col, count(distinct v) as u, count(*) filter (not ok) as bad from fit group by col)
select n.col as "column", n.n as null_count, round_even(n.n / n.total, 4) as null_ratio, coalesce(u, 0) as unique_count,
  coalesce(domain, '일반 텍스트') as detected_domain, coalesce(bad, 0) as invalid_format_count, n.total
from nulls n left join uniq using (col) left join domains using (col)"""


def sheet(spark, folder):
    """Orders as a sheet of strings with dates, blanks, null words and numbers of mixed shape."""
    return fan_out(table(spark, folder, "orders"), "o_orderkey").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"),
        F.when(F.col("o_orderkey") % 11 == 0, "NULL").when(F.col("o_orderkey") % 13 == 0, " ").otherwise(F.col("o_orderstatus")).alias("status"),
        F.concat(F.lit("010-"), F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0"), F.lit("-"),
                 F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0")).alias("phone"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 50 == 49, " at ").otherwise("@"), F.lit("mail.example.com")).alias("email"),
        F.when(F.col("o_orderkey") % 97 == 96, "n/a").otherwise(F.col("o_custkey").cast("string")).alias("customer"),
    )


SHEET_COLUMNS = {
    "o_orderkey": "o_orderkey::varchar", "order_date": "strftime(o_orderdate, '%Y-%m-%d')",
    "status": "case when o_orderkey % 11 = 0 then 'NULL' when o_orderkey % 13 = 0 then ' ' else o_orderstatus end",
    "phone": "'010-' || lpad((o_custkey % 10000)::varchar, 4, '0') || '-' || lpad((o_orderkey % 10000)::varchar, 4, '0')",
    "email": "'c' || o_custkey::varchar || case when o_orderkey % 50 = 49 then ' at ' else '@' end || 'mail.example.com'",
    "customer": "case when o_orderkey % 97 = 96 then 'n/a' else o_custkey::varchar end",
}
SHEET_CELLS = " union all ".join(
    f"select o_orderkey as pos, '{c}' as col, {expression} as raw from orders" for c, expression in SHEET_COLUMNS.items())


@R.add("AGG-20_column_profile", profile_sql(SHEET_CELLS))
def column_profile(spark, folder):
    return profile.column_profile(sheet(spark, folder), ["o_orderkey"])


@R.add("QLT-05_domain_inference", f'select "column", detected_domain, invalid_format_count from ({profile_sql(SHEET_CELLS, 20)})')
def domain_inference(spark, folder):
    return profile.column_profile(sheet(spark, folder), ["o_orderkey"], sample=20).select("column", "detected_domain", "invalid_format_count")


DATASET_SQL = f"""
with prof as ({profile_sql(SHEET_CELLS)}),
s as (select sum(null_count) as nulls, sum(total) as cells, max(total) as total_rows, count(*) as total_columns,
  sum(least(20, invalid_format_count * 2)) as bad from prof),
k as (select count(*) - count(distinct phone) as dup from (select {SHEET_COLUMNS['phone']} as phone from orders)),
r as (select *, greatest(0, least(100, greatest(0, 100 - floor(nulls / cells * 200)) - bad - least(30, dup * 5))) as score from s, k)
select score::bigint as score, case when score >= 95 then '로컬 1단계 (참고)' when score >= 80 then '로컬 2단계 (참고)' else '로컬 3단계 (참고)' end as grade,
  total_rows::bigint as total_rows, total_columns, round_even(nulls / cells, 4) as overall_null_ratio,
  dup as pk_duplicate_count, 0::bigint as row_schema_mismatch_count from r"""


@R.add("QLT-03_dataset_score", DATASET_SQL)
def dataset_score(spark, folder):
    return profile.evaluate_dataset(sheet(spark, folder), ["o_orderkey"], "phone")


@R.add("QLT-04_null_and_valid", """
with c as (select v from (select case when o_orderkey % 11 = 0 then 'NULL' when o_orderkey % 13 = 0 then ' null ' when o_orderkey % 7 = 0 then '-'
  else o_orderpriority end as v from orders))
select count(*) filter (trim(v) = '' or lower(v) in ('null', 'none', 'nan', '-')) as null_values,
  count(*) filter (trim(v) not in ('', 'null', 'none', 'nan', '-')) as valid_values,
  count(distinct trim(v)) filter (trim(v) not in ('', 'null', 'none', 'nan', '-')) as distinct_valid from c""")
def null_and_valid(spark, folder):
    key = F.col("o_orderkey")
    v = F.when(key % 11 == 0, "NULL").when(key % 13 == 0, " null ").when(key % 7 == 0, "-").otherwise(F.col("o_orderpriority"))
    df = table(spark, folder, "orders").select(v.alias("v"))
    valid = profile.is_valid_value(F.col("v"))
    return df.agg(
        F.count_if(profile.is_null_value(F.col("v"))).alias("null_values"), F.count_if(valid).alias("valid_values"),
        F.count_distinct(F.when(valid, F.trim("v"))).alias("distinct_valid"))


@R.add("QLT-06_key_duplicates", "select count(*) - count(distinct user_id) as pk_duplicate_count from events where user_id is not null and user_id <> 0")
def key_duplicates(spark, folder):
    return profile.key_duplicates(table(spark, folder, "events"), "user_id")


@R.add("QLT-07_schema_mismatch", """
select count(*) filter ((o_orderkey % 17 = 3) <> first_odd) as row_schema_mismatch_count
from orders, (select min_by(o_orderkey % 17 = 3, o_orderkey) as first_odd from orders)""")
def schema_mismatch(spark, folder):
    """Rows read as records; some carry one more key."""
    keys = F.when(F.col("o_orderkey") % 17 == 3, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("b"), F.lit("a")))
    return profile.mismatched_rows(table(spark, folder, "orders"), keys, [F.col("o_orderkey")])


@R.add("DAT-01_date_validity", r"""
with d as (select o_orderkey, strftime(o_orderdate, '%Y') || case when o_orderkey % 3 = 0 then '/' else '-' end
  || case when o_orderkey % 5 = 0 then '13' else strftime(o_orderdate, '%m') end || case when o_orderkey % 7 = 0 then '-' when o_orderkey % 3 = 0 then '/' else '-' end
  || case when o_orderkey % 4 = 0 then '31' else strftime(o_orderdate, '%d') end as v from orders)
select o_orderkey, regexp_matches(v, '^(\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{4}\.\d{2}\.\d{2})$')
  and try_cast(translate(v, '/.', '--') as date) is not null as valid from d""")
def date_validity(spark, folder):
    from corpusmill.functions.text import valid_calendar_date

    key = F.col("o_orderkey")
    mark = F.when(key % 3 == 0, "/").otherwise("-")
    text = F.concat(F.date_format("o_orderdate", "yyyy"), mark, F.when(key % 5 == 0, "13").otherwise(F.date_format("o_orderdate", "MM")),
                    F.when(key % 7 == 0, "-").otherwise(mark), F.when(key % 4 == 0, "31").otherwise(F.date_format("o_orderdate", "dd")))
    return table(spark, folder, "orders").select("o_orderkey", text.alias("v")).select("o_orderkey", valid_calendar_date("v").alias("valid"))


@R.add("FLT-06_document_ids", "select o_orderkey, o_custkey from orders where o_custkey in (1, 7, 44, 370)")
def document_ids(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("document_id"))
    return filters.in_scope(df, filters.SearchScope(document_ids=(1, 7, 44, 370))).select("o_orderkey", F.col("document_id").alias("o_custkey"))


SCOPE_SQL = """
with c as (select c_custkey, c_nationkey % 3 as dep, case when c_custkey % 10 = 0 then null when c_custkey % 10 = 1 then 'x' else (c_custkey % 6)::varchar end as lvl,
  c_mktsegment as project, case when c_custkey % 9 = 0 then null else (c_custkey % 101)::int end as q from customer)
select c_custkey from c where {}"""


def scoped(spark, folder, scope):
    key = F.col("c_custkey")
    df = table(spark, folder, "customer").select(
        "c_custkey", F.when(F.col("c_nationkey") % 3 == 0, "sales").when(F.col("c_nationkey") % 3 == 1, filters.SHARED_DEPARTMENT).alias("department"),
        F.when(key % 10 == 0, None).when(key % 10 == 1, "x").otherwise((key % 6).cast("string")).alias("security_level"),
        F.col("c_mktsegment").alias("project_name"), F.when(key % 9 != 0, (key % 101).cast("int")).alias("quality_score"))
    return filters.in_scope(df, scope).select("c_custkey")


R.add("FLT-07_min_quality", SCOPE_SQL.format("coalesce(q, 0) >= 50"))(lambda s, d: scoped(s, d, filters.SearchScope(min_quality=50)))
R.add("FLT-08_project", SCOPE_SQL.format("project = 'BUILDING'"))(lambda s, d: scoped(s, d, filters.SearchScope(project="BUILDING")))
R.add("FLT-09_department", SCOPE_SQL.format("dep in (1, 2)"))(lambda s, d: scoped(s, d, filters.SearchScope(department="hr")))
R.add("FLT-09_department_strict", SCOPE_SQL.format("dep = 0"))(
    lambda s, d: scoped(s, d, filters.SearchScope(department="sales", strict_department=True)))
R.add("FLT-10_security", SCOPE_SQL.format("coalesce(try_cast(lvl as int), 1) <= 2"))(lambda s, d: scoped(s, d, filters.SearchScope(max_security=2)))
R.add("FLT-11_all_scopes", SCOPE_SQL.format("coalesce(q, 0) >= 20 and project <> '' and dep in (0, 1, 2) and coalesce(try_cast(lvl as int), 1) <= 3 and project = 'MACHINERY'"))(
    lambda s, d: scoped(s, d, filters.SearchScope(min_quality=20, project="MACHINERY", department="sales", max_security=3)))
