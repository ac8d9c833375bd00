"""Read-only SQL over the test tables, one query for each group of features; SQL holds the same for another engine where the spelling differs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.shared import table
from tidemark.sources.sqlview import SqlView

VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "sql_expressions": (
        """select o_orderkey, case when o_orderpriority like '1-%' then 'first' when o_orderpriority in ('2-HIGH', '3-MEDIUM') then 'middle' else lower(o_orderpriority) end as band,
  cast(o_custkey as string) || '/' || coalesce(nullif(o_orderstatus, 'O'), '-') as tag, o_custkey % 7 between 2 and 4 as inner_band
from orders where not (o_orderstatus = 'F' and o_orderkey < 100) or o_custkey is null""",
        ("orders",),
    ),
    "sql_joins": (
        """select n_name, count(*) as customers, count(x.o_custkey) as ordering, sum(case when exists (select 1 from orders o where o.o_custkey = c_custkey and o.o_orderstatus = 'P') then 1 else 0 end) as pending,
  sum(case when c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT') then 1 else 0 end) as urgent
from customer join nation on c_nationkey = n_nationkey left join (select distinct o_custkey from orders) x on x.o_custkey = c_custkey
where not exists (select 1 from region r where r.r_regionkey = n_regionkey and r.r_name = 'ASIA') group by n_name
union all select r_name || '*' || n_name, 0, 0, 0, 0 from region cross join nation where r_regionkey < n_regionkey""",
        ("customer", "nation", "orders", "region"),
    ),
    "sql_grouping_sets": (
        """select l_returnflag, l_linestatus, grouping(l_returnflag) + 0 as all_flags, count(*) as n, count(distinct l_suppkey) as suppliers, sum(cast(l_quantity as bigint)) filter (where l_linenumber = 1) as first_lines
from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), ()) having count(*) > 1
union all select l_returnflag, l_linestatus, 7, count(*), 0, 0 from lineitem group by rollup (l_returnflag, l_linestatus)""",
        ("lineitem",),
    ),
    "sql_windows": (
        """select o_orderkey, row_number() over w as n, rank() over (partition by o_custkey order by o_orderstatus) as r, dense_rank() over (partition by o_custkey order by o_orderstatus) as d,
  lag(o_orderkey) over w as before, lead(o_orderkey, 2) over w as after, first_value(o_orderkey) over w as first, ntile(3) over w as third,
  sum(o_orderkey) over (partition by o_custkey order by o_orderkey rows between 1 preceding and 1 following) as near,
  count(*) over (partition by o_custkey order by o_orderkey range between 1000 preceding and current row) as close_by
from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)""",
        ("orders",),
    ),
    "sql_top": ("select o_orderkey, o_custkey from orders order by o_custkey desc, o_orderkey limit 25 offset 5", ("orders",)),
    "sql_sets": (
        """select k from (select o_custkey as k from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'O') a
except select o_custkey from orders where o_orderstatus = 'P' union all select distinct -n_nationkey from nation""",
        ("orders", "nation"),
    ),
    "sql_subqueries": (
        """with recursive steps (n, total) as (select 1, 1 union all select n + 1, total + n + 1 from steps where n < 20)
select c_custkey, last_key, (select count(*) from orders o where o.o_custkey = c.c_custkey) as orders, (select max(total) from steps where n <= c.c_nationkey) as triangle
from customer c, lateral (select max(o.o_orderkey) as last_key from orders o where o.o_custkey = c.c_custkey) m""",
        ("customer", "orders"),
    ),
    "sql_unnest": (
        """select instrument_id, sequence, side, level.price.units as units, level.order_count as order_count from (
  select instrument_id, sequence, 'bid' as side, explode(bids) as level from book_snapshots union all select instrument_id, sequence, 'ask', explode(filter(asks, x -> x.quantity is not null)) from book_snapshots) s""",
        ("book_snapshots",),
    ),
    "sql_nested": (
        """select delivery_id, price.units as units, struct(price.scale, sequence).scale as scale, map('a', sequence, 'b', -sequence)['b'] as negative,
  cast(get_json_object('{"x": {"y": [3, 4]}}', '$.x.y[1]') as int) as four, element_at(split(instrument_id, ':'), -1) as symbol from market_trades""",
        ("market_trades",),
    ),
    "sql_pivot": ("select o_orderpriority, F, O, P from (select o_orderpriority, o_orderstatus, o_orderkey from orders) pivot (count(o_orderkey) for o_orderstatus in ('F', 'O', 'P'))", ("orders",)),
    "sql_qualify": (
        """select o_custkey, o_orderkey, o_orderstatus from orders qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1
union all select 0, max(n), 'n' from (select o_orderkey as n, o_custkey from orders qualify count(*) over (partition by o_custkey) > 3) q""",
        ("orders",),
    ),
    "sql_parameters": ("select o_orderpriority, count(*) as n from orders where o_custkey > ? and o_orderstatus = ? group by o_orderpriority", ("orders",)),
}
ARGUMENTS = {"sql_parameters": [50, "O"]}

SQL = {name: sql for name, (sql, _) in VIEWS.items()} | {
    "sql_unnest": """select instrument_id, sequence, side, level.price.units as units, level.order_count as order_count from (
  select instrument_id, sequence, 'bid' as side, unnest(bids) as level from book_snapshots union all select instrument_id, sequence, 'ask', unnest(list_filter(asks, lambda x: x.quantity is not null)) from book_snapshots) s""",
    "sql_nested": """select delivery_id, price.units as units, struct_pack(scale := price.scale, sequence := sequence).scale as scale, map {'a': sequence, 'b': -sequence}['b'] as negative,
  cast(json_extract('{"x": {"y": [3, 4]}}', '$.x.y[1]') as int) as four, string_split(instrument_id, ':')[-1] as symbol from market_trades""",
    "sql_parameters": "select o_orderpriority, count(*) as n from orders where o_custkey > 50 and o_orderstatus = 'O' group by o_orderpriority",
}


def _query(name: str):
    sql, tables = VIEWS[name]

    def run(spark: SparkSession, d: str) -> DataFrame:
        return SqlView({t: table(spark, d, t) for t in tables}).query(sql, ARGUMENTS.get(name))

    return run


QUERIES = {name: _query(name) for name in VIEWS}
