"""Registration, output types and SQL fragments shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import KEYWORD_PATTERN, KEYWORD_STOPWORDS, TOKEN_PATTERN, TOKEN_STOPWORDS
from corpusmill.session import ship_package


def out(df: DataFrame) -> DataFrame:
    """Integers as bigint and floats as double, so both engines return the same types."""
    wide = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double"}
    return df.select(*[F.col(f"`{c}`").cast(wide[t]).alias(c) if t in wide else F.col(f"`{c}`") for c, t in df.dtypes])


def exact_rounding(sql: str) -> str:
    """round_even of this SQL engine scales the value first, which moves values beside a tie;
    formatting rounds the exact binary value, ties to even."""
    while (at := sql.find("round_even(")) >= 0:
        depth, i, comma = 0, at + len("round_even"), None
        while True:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            if sql[i] == "," and depth == 1:
                comma = i
            if depth == 0:
                break
            i += 1
        value, digits = sql[at + len("round_even(") : comma], sql[comma + 1 : i].strip()
        sql = f"{sql[:at]}printf('%.{digits}f', ({value})::double)::double{sql[i + 1:]}"
    return sql


class Registry:
    def __init__(self):
        self.queries, self.oracles = {}, {}

    def add(self, name: str, sql: str | None = None):
        def register(function):
            def run(spark, folder):
                ship_package(spark)
                return out(function(spark, folder))

            self.queries[name] = run
            if sql is not None:
                self.oracles[name] = exact_rounding(sql)
            return function

        return register


def quoted(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_tokens(column: str) -> str:
    return (
        f"list_filter(regexp_extract_all(lower({column}), '{TOKEN_PATTERN}'), "
        f"lambda t: length(t) >= 2 and not list_contains({quoted(TOKEN_STOPWORDS)}, t))"
    )


def sql_keywords(column: str) -> str:
    return (
        f"list_distinct(list_filter(regexp_extract_all(lower({column}), '{KEYWORD_PATTERN}'), "
        f"lambda t: not list_contains({quoted(KEYWORD_STOPWORDS)}, t)))"
    )


def by_id(key: str, phrases: list[str]) -> tuple[Callable[[], Column], str]:
    """One of the phrases for each row, chosen by its id, as a column (once called) and as SQL: feeds branches that the tables alone do not reach."""

    def column() -> Column:
        return F.element_at(F.array(*map(F.lit, phrases)), (F.col(key) % len(phrases) + 1).cast("int"))

    return column, f"({quoted(phrases)}[({key} % {len(phrases)} + 1)::int])"


SQL_SPACE = r"' ' || chr(9) || chr(10) || chr(13)"


def sql_strip(column: str) -> str:
    return f"trim({column}, {SQL_SPACE})"


def sql_number(column: str) -> str:
    text = f"nullif(trim({column}), '')"
    return (
        f"(case when regexp_full_match({text}, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') "
        f"then try_cast({text} as double) end)"
    )


# Whole documents as chunks with tokens and a 64-slot hash embedding; 64 divides 2^64, so the
# slot is the low six bits of the 64-bit prefix of the digest.
SQL_SLOT = (
    "(strpos('0123456789abcdef', substr(sha256(w), 15, 1)) - 1) % 4 * 16 "
    "+ strpos('0123456789abcdef', substr(sha256(w), 16, 1)) - 1"
)


def sql_hash_vectors(name: str, source: str, key: str, text: str) -> str:
    """CTEs giving {name}(key, vec double[64])."""
    return f"""
{name}_w as (
  select {key} as id, unnest(case when len(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+')) = 0
    then [{text}] else regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+') end) as w from {source}
),
{name}_c as (select id, {SQL_SLOT} as slot, count(*)::double as n from {name}_w group by all),
{name}_n as (select id, sqrt(sum(n * n)) as norm from {name}_c group by id),
{name} as (select c.id, c.slot, c.n / m.norm as x from {name}_c c join {name}_n m using (id))"""


def sql_chunks(name: str, source: str, size: int, overlap: int) -> str:
    """CTEs giving {name}(id, chunk_index, text, char_start, char_end) for the normalized texts of {source}(id, t).

    A walk from chunk to chunk: a chunk of ``size`` characters ends at the last line end or sentence gap in the last 45 % of
    its window, outside Markdown table rows, and the next one begins ``overlap`` characters before that. Needs ``with recursive``.
    """
    line = "list_last(list_filter(ls, lambda x: x <= {}))"
    return f"""
{name}_p as (select id, i, length(x) as w, length(x) - length(rtrim(x, {SQL_SPACE})) as g, starts_with(right(x, length(x) - length(rtrim(x, {SQL_SPACE}))), chr(10) || chr(10)) as blank
  from (select id, unnest(ps) as x, generate_subscripts(ps, 1) as i from (select id, regexp_extract_all(t, '(?s).*?[.!?。！？]\\s+') as ps from {source}))),
{name}_g as (select id, list({{'b': e - g, 'e': e}} order by e) as gs from (
  select *, sum(w) over (partition by id order by i)::bigint as e from {name}_p) where not blank group by id),
{name}_n as (select id, list(e order by e) as ls from (
  select id, coalesce(sum(length(x) + 1) over (partition by id order by i rows between unbounded preceding and 1 preceding), 0)::bigint as e
  from (select id, unnest(ps) as x, generate_subscripts(ps, 1) as i from (select id, string_split(t, chr(10)) as ps from {source}))) group by id),
{name}_s as (select s.id, t, length(t) as n, ls, coalesce(gs, []) as gs from {source} s join {name}_n using (id) left join {name}_g using (id) where t <> ''),
{name}_w as (
  select id, 0::bigint as s, -1::bigint as e from {name}_s
  union all
  select id, s, case when s + {size} >= n then n when edge = b or not tabled then b when follow - 1 - s <= floor((b - s) * 1.2::double) then follow
    when edge > s + 1 then edge else b end as e
  from (select *, substr(r, 1, 1) = '|' and substr(r, length(r), 1) = '|' as tabled from (
    select *, {sql_strip("substr(t, (case when edge > s then edge else 0 end + 1)::bigint, (coalesce(follow - 1, n) - case when edge > s then edge else 0 end)::bigint)")} as r from (
    select *, {line.format('b')} as edge, list_first(list_filter(ls, lambda x: x > b)) as follow from (
    select *, case when greatest(l, g) > 0 then greatest(l, g) else s + {size} end as b from (
    select *, case when {line.format(f's + {size}')} > low then {line.format(f's + {size}')} else 0 end as l,
      coalesce(list_last(list_transform(list_filter(gs, lambda x: x.b < s + {size}), lambda x: case when x.b >= low then least(x.e, s + {size}) else 0 end)), 0) as g from (
    select *, s + {int(size * 0.55)} as low from (
    select d.*, case when w.e < 0 then 0 else greatest(case when {sql_strip('substr(d.t, w.s + 1, w.e - w.s)')} = '' then w.e else w.e - {overlap} end, w.s + 1) end as s
    from {name}_w w join {name}_s d using (id) where w.e < d.n) where s < n))))))),
{name}_c as (select id, s, {sql_strip('substr(t, s + 1, e - s)')} as text, s + length(substr(t, s + 1, e - s)) - length(ltrim(substr(t, s + 1, e - s), {SQL_SPACE})) as char_start
  from {name}_w join {name}_s using (id) where e >= 0),
{name} as (select id, row_number() over (partition by id order by s) - 1 as chunk_index, text, char_start, char_start + length(text) as char_end
  from {name}_c where text <> '')"""
