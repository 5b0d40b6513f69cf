"""The end-to-end query: split, fit on train, replay, encode, summarise per split."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators.encode import encode
from corpusloom.operators.prepare import prepare_table
from .d_sampling import split_sql
from .registry import query, table


def _z(c: str) -> str:
    return f"round(avg((({c} - m_{c}) / s_{c})::float::double), 4) as {c}"


_STATS = ", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in ("value", "value_log1p", "props_frequency"))


@query("x1_prepare_events", f"""
with src as (select event_id, value, props, event_type from events),
{split_sql('src', 'event_type', 'event_id', '0.2', '0.5')},
train as (select * from split_rows where split = 'train'),
nt as (select count(*) as n from train),
pv as (select props, count(*) / (select n from nt) as f, count(*) >= greatest(2, floor((select n from nt) * 0.01)) as keep from train group by props),
ps as (select count_if(keep) > 1 and count_if(keep) < count(*) as collapses from pv),
rows as (select r.*, if((select collapses from ps), if(coalesce(keep, false), r.props, '__RARE__'), r.props) as cat,
  if((select collapses from ps) and not coalesce(keep, false), 0.0::double, coalesce(f, 0.0::double)) as props_frequency, ln(1 + value) as value_log1p
  from split_rows r left join pv using (props)),
vocab as (select cat, row_number() over (order by cat) as code from (select distinct cat from rows where split = 'train')),
classes as (select event_type, row_number() over (order by event_type) - 1 as y from (select distinct event_type from train)),
stats as (select {_STATS} from rows where split = 'train')
select split, count(*) as n, {_z('value')}, {_z('value_log1p')}, {_z('props_frequency')},
  sum(coalesce(code, 0))::bigint as code_sum, sum(y)::bigint as y_sum, count_if(code is null)::bigint as n_unknown
from rows left join vocab using (cat) join classes using (event_type), stats group by split""")
def x1(spark, sf):
    events = table(spark, sf, "events").select("event_id", "value", "props", "event_type")
    prepared = prepare_table(events, ["event_id"], target="event_type", task="multiclass", title="events")
    rows = encode(prepared.rows, prepared.schema, keep=["split"])
    names = list(prepared.schema.numeric)
    means = [F.round(F.avg(F.col("x_num")[i].cast("double")), 4).alias(c) for i, c in enumerate(names)]
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), *means, F.sum(F.col("x_cat")[0]).alias("code_sum"),
                                     F.sum("y").alias("y_sum"), F.count_if(F.col("x_cat")[0] == 0).alias("n_unknown"))
