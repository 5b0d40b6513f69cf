"""Pieces of check SQL that several queries share."""

from __future__ import annotations

NUMBER = (r"'^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$'")
DATE = (r"'^(\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}/\d{1,2}/\d{4})([ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$'")


def number(x: str) -> str:
    return f"case when regexp_matches({x}, {NUMBER}) then try_cast(trim({x}) as double) end"


def date(x: str) -> str:
    iso = rf"replace(regexp_replace({x}, '^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})', '\3-\1-\2'), '/', '-')"
    return f"case when regexp_matches({x}, {DATE}) then try_cast({iso} as timestamp) end"


def norm(x: str) -> str:
    return f"coalesce(nullif(trim(regexp_replace(lower({x}), '[^0-9a-zA-Z]+', '_', 'g'), '_'), ''), 'column')"


def unit(text: str) -> str:
    """Uniform double from md5 of a SQL string expression."""
    return f"(('0x' || substr(md5({text}), 1, 13))::bigint / 4503599627370496.0)"


def values(mapping: dict, names: str) -> str:
    rows = ", ".join(f"('{k}', {float(v)})" for k, v in mapping.items())
    return f"(values {rows}) as {names}"


def text_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def profile(source: str, columns: list[str], numeric: list[str]) -> str:
    """CTE chain ending in `prof`, the column profile of `source`, and `prob` with type probabilities."""
    cells = " union all ".join(
        f"select '{c}' as col, {i + 1} as position, cast({c} as varchar) as v from src" for i, c in enumerate(columns))
    numeric_list = ", ".join(f"'{c}'" for c in numeric) or "''"
    return f"""
with src as ({source}), cells as ({cells}),
cnts as (select col, v, count(*) as c from cells where v is not null group by col, v),
tops as (select col, max(c) as top from cnts group by col),
base as (
  select col, min(position) as position, count(*) as n_rows, count(v) as n_valid,
    count(distinct v) as n_distinct, coalesce(sum(length(v)), 0) as n_chars,
    count({number('v')}) as n_numeric, count({date('v')}) as n_datetime,
    coalesce(bool_and({number('v')} - floor({number('v')}) <= 1e-8), false) as integer_like
  from cells group by col),
prof as (
  select base.*, col in ({numeric_list}) as prefer_numeric,
    (n_rows - n_valid) / n_rows as missing_ratio,
    case when n_valid > 0 then n_distinct / n_valid else 0.0 end as unique_ratio,
    case when n_valid > 0 then top / n_valid else 0.0 end as top_frequency_ratio,
    case when n_valid > 0 then n_chars / n_valid else 0.0 end as avg_string_length,
    case when n_valid > 0 then n_numeric / n_valid else 0.0 end as parse_numeric_ratio,
    case when n_valid > 0 then n_datetime / n_valid else 0.0 end as parse_datetime_ratio
  from base left join tops using (col)),
score as (
  select *, greatest(0.15 + 1.2 * parse_numeric_ratio + if(prefer_numeric, 0.3, 0.0), 1e-6) as s1,
    greatest(0.15 + 0.9 * greatest(0.0, 0.2 - unique_ratio) + if(prefer_numeric, 0.0, 0.25), 1e-6) as s2,
    greatest(0.10 + 0.8 * avg_string_length / 32.0 + 0.5 * unique_ratio, 1e-6) as s3,
    greatest(0.10 + if(lower(col) in ('id','row_id','customer_id') or lower(col) like '%\\_id' escape '\\', 1.2, 0.0)
      + 0.9 * greatest(0.0, unique_ratio - 0.95), 1e-6) as s4,
    greatest(0.10 + 1.3 * parse_datetime_ratio, 1e-6) as s5
  from prof),
prob as (
  select *, s1/(s1+s2+s3+s4+s5) as p1, s2/(s1+s2+s3+s4+s5) as p2, s3/(s1+s2+s3+s4+s5) as p3,
    s4/(s1+s2+s3+s4+s5) as p4, s5/(s1+s2+s3+s4+s5) as p5 from score)"""
