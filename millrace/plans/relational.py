"""Projection, filter, join, set and ordering queries."""

from pyspark.sql import functions as F

from millrace.operators import joins, project, sets
from millrace.operators.predicate import query as where
from millrace.plans.registry import query


# --- columns and missing values -------------------------------------------------------------

@query("filter_columns", "select o_totalprice, o_orderkey from orders")
def _(t):
    return project.filter_columns(t.orders, "o_totalprice, o_orderkey, no_such_column")


@query("drop_columns", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders")
def _(t):
    return project.drop_columns(t.orders, "o_orderdate, o_orderpriority")


@query("rename_columns", "select s_suppkey as id, s_name as name, s_nationkey as nation, s_acctbal as balance from supplier")
def _(t):
    return project.rename_one(project.rename_columns(t.supplier, "id, label, nation, balance"), 1, "name")


_NULLED = """
  select l_orderkey, l_linenumber, nullif(l_discount, 0.0) as l_discount,
         nullif(l_returnflag, 'A') as l_returnflag, nullif(l_linenumber, 3) as line
  from lineitem
"""


def _nulled(t):
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        F.expr("nullif(l_discount, 0.0D)").alias("l_discount"),
        F.expr("nullif(l_returnflag, 'A')").alias("l_returnflag"),
        F.expr("nullif(l_linenumber, 3)").alias("line"),
    )


@query("drop_nans", f"select * from ({_NULLED}) where l_discount is not null and l_returnflag is not null and line is not null")
def _(t):
    return project.drop_nans(_nulled(t))


@query(
    "fill_nans_zero",
    f"select l_orderkey, l_linenumber, coalesce(l_discount, 0.0) as l_discount, coalesce(l_returnflag, '0') as l_returnflag, coalesce(line, 0) as line from ({_NULLED})",
)
def _(t):
    return project.fill_nans(_nulled(t))


@query(
    "fill_nans_map",
    f"select l_orderkey, l_linenumber, coalesce(l_discount, 0.5) as l_discount, coalesce(l_returnflag, 'missing') as l_returnflag, line from ({_NULLED})",
)
def _(t):
    return project.fill_nans(_nulled(t), {"l_discount": 0.5, "l_returnflag": "missing"})


@query(
    "blank_to_null",
    "select p_partkey, nullif(case when p_size % 4 = 0 then ' ' when p_size % 4 = 1 then '  ' else p_type end, ' ') as kind from part",
)
def _(t):
    kind = F.expr("case when p_size % 4 = 0 then ' ' when p_size % 4 = 1 then '  ' else p_type end")
    return project.blank_to_null(t.part.select("p_partkey", kind.alias("kind")))


@query("label_column", "select vec_id, label, label % 2 as \"LABEL\" from embeddings".replace("label, label", "label as cluster, label"))
def _(t):
    df = t.embeddings.select("vec_id", F.col("label").alias("cluster"))
    return project.with_label(df, F.col("cluster") % 2)


@query(
    "round_for_display",
    "select s_suppkey, round(s_acctbal / 8 + 0.0001, 3) as share from supplier",
)
def _(t):
    return project.round_for_display(t.supplier.select("s_suppkey", (F.col("s_acctbal") / 8 + 0.0001).alias("share")))


# --- predicates -----------------------------------------------------------------------------

@query("query_simple", "select * from orders where o_totalprice > 200000 and not (o_orderstatus = 'F' or o_custkey <= 100)")
def _(t):
    return where(t.orders, "o_totalprice > 200000 and not (o_orderstatus == 'F' or o_custkey <= 100)")


@query("query_in", "select * from part where p_type in ('SMALL', 'ECONOMY') and p_size not in (1, 2, 3)")
def _(t):
    return where(t.part, "p_type in ['SMALL', 'ECONOMY'] & `p_size` not in [1, 2, 3]")


@query("query_chained", "select * from lineitem where 0.02 < l_discount and l_discount <= 0.05 and (l_quantity < 10 or l_tax * 2 > 0.1)")
def _(t):
    return where(t.lineitem, "0.02 < l_discount <= 0.05 & (l_quantity < 10 | l_tax * 2 > 0.1)")


@query(
    "query_ne_null",
    """select o_orderkey, p, b from (select o_orderkey, nullif(o_orderpriority, '5-LOW') as p, nullif(o_orderstatus, 'P') as b from orders)
       where (p is null or p <> '2-HIGH') and not coalesce(b = 'O', false)""",
)
def _(t):
    df = t.orders.select(
        "o_orderkey", F.expr("nullif(o_orderpriority, '5-LOW')").alias("p"), F.expr("nullif(o_orderstatus, 'P')").alias("b")
    )
    return where(df, "p != '2-HIGH' and not b == 'O'")


# --- predictions ----------------------------------------------------------------------------

@query(
    "mark_correct",
    """select doc_id, quality as label, cast(n_chars > 1000 as integer) as predictions,
              case when quality = cast(n_chars > 1000 as integer) then '✅' else '❌' end as results
       from labels join documents using (doc_id)""",
)
def _(t):
    return project.mark_correct(_rule_scores(t).select("doc_id", "label", "predictions"), "label")


def _rule_scores(t):
    """Quality labels against a length rule; the score is the text length."""
    return t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(
        "doc_id", F.col("quality").alias("label"), (F.col("n_chars") > 1000).cast("int").alias("predictions"), "n_chars"
    )


@query(
    "signed_error",
    """select p_partkey, p_size as label, p_size_guess as predictions, p_size - p_size_guess as absolute_error, abs(p_size - p_size_guess) as abs_error
       from (select p_partkey, p_size, cast(p_partkey % 50 as integer) as p_size_guess from part)""",
)
def _(t):
    df = t.part.select("p_partkey", F.col("p_size").alias("label"), (F.col("p_partkey") % 50).cast("int").alias("predictions"))
    return project.signed_error(df, "label", magnitude=True)


@query(
    "remap_anomaly",
    """select event_id, case p when -1 then 1 when 1 then 0 else p end as predictions
       from (select event_id, case when value > 400 then -1 when value > 5 then 1 else 0 end as p from events)""",
)
def _(t):
    p = F.expr("case when value > 400 then -1 when value > 5 then 1 else 0 end").alias("predictions")
    return project.remap_anomaly(t.events.select("event_id", p))


@query("score_threshold", "select l_orderkey, l_linenumber, l_quantity / 50 as score from lineitem where l_quantity / 50 >= 0.6")
def _(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("score"))
    return project.score_threshold(df, "score", 0.6)


@query(
    "target_class_hits",
    """select event_id, value as predictions, cast(trunc(value) = 7 as integer) as hit from events""",
)
def _(t):
    df = t.events.select("event_id", F.col("value").alias("predictions"))
    return project.target_class_hits(df, "7.9", regression=True)


# --- joins ----------------------------------------------------------------------------------

@query(
    "merge_outer",
    """select coalesce(k, k2) as k, c_name, c_acctbal, o_orderkey, o_totalprice
       from (select c_custkey as k, c_name, c_acctbal from customer) c
       full outer join (select o_custkey + 300 as k2, o_orderkey, o_totalprice from orders) o on k = k2""",
)
def _(t):
    left = t.customer.select(F.col("c_custkey").alias("k"), "c_name", "c_acctbal")
    right = t.orders.select((F.col("o_custkey") + 300).alias("k"), "o_orderkey", "o_totalprice")
    return joins.merge(left, right, "k")


@query(
    "merge_suffix",
    """select coalesce(s.id, c.id) as id, s.nation as nation_x, c.nation as nation_y, s.name as name_x, c.name as name_y, s.balance
       from (select s_suppkey as id, s_nationkey as nation, s_name as name, s_acctbal as balance from supplier) s
       full outer join (select c_custkey as id, c_nationkey as nation, c_name as name from customer) c on s.id = c.id""",
)
def _(t):
    left = t.supplier.selectExpr("s_suppkey as id", "s_nationkey as nation", "s_name as name", "s_acctbal as balance")
    right = t.customer.selectExpr("c_custkey as id", "c_nationkey as nation", "c_name as name")
    return joins.merge_sorted(left, right, "id")


@query(
    "merge_null_keys",
    """select coalesce(a.k, b.k) as k, a.n_parts, b.n_lines
       from (select nullif(p_size, 7) as k, count(*) as n_parts from part group by 1) a
       full outer join (select nullif(l_linenumber, 7) as k, count(*) as n_lines from lineitem group by 1) b
       on a.k is not distinct from b.k""",
)
def _(t):
    left = t.part.groupBy(F.expr("nullif(p_size, 7)").alias("k")).agg(F.count("*").alias("n_parts"))
    right = t.lineitem.groupBy(F.expr("nullif(l_linenumber, 7)").alias("k")).agg(F.count("*").alias("n_lines"))
    return joins.merge(left, right, "k")


@query(
    "upsert_orders",
    """with changes as (select o_orderkey * 2 as o_orderkey, o_totalprice + 1 as o_totalprice, 'U' as o_orderstatus from orders where o_orderstatus = 'P'),
       base as (select o_orderkey, o_totalprice, o_orderstatus from orders)
       select * from changes union all select * from base where o_orderkey not in (select o_orderkey from changes)""",
)
def _(t):
    base = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    changes = t.orders.where("o_orderstatus = 'P'").selectExpr(
        "o_orderkey * 2 as o_orderkey", "o_totalprice + 1 as o_totalprice", "'U' as o_orderstatus"
    )
    return joins.upsert(base, changes, "o_orderkey")


@query(
    "upsert_last_write",
    """select user_id, event_id, event_type, value from events
       qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""",
)
def _(t):
    df = t.events.select("user_id", "event_id", "event_type", "value", "ts")
    return joins.last_write(df, "user_id", ["ts", "event_id"]).drop("ts")


@query(
    "anti_new_keys",
    "select o_orderkey, o_custkey from orders where o_orderkey not in (select l_orderkey from lineitem)",
)
def _(t):
    seen = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.new_keys(t.orders.select("o_orderkey", "o_custkey"), seen, "o_orderkey")


@query(
    "scenario_grid",
    """select p_partkey, strftime(d, '%Y-%m-%d') as eval_date, s as shock
       from part, (select unnest(generate_series(date '2024-01-01', date '2024-06-01', interval 1 month)) as d),
            (select unnest([0.0, 0.05, 0.1]) as s)""",
)
def _(t):
    grid = joins.scenario_grid(t.part.select("p_partkey"), "2024-01-01", "2024-06-01", 1, joins.shock_range(0, 0.1, 0.05))
    return grid.withColumn("eval_date", F.col("eval_date").cast("string"))


@query(
    "pair_by_name",
    """select p.url as left_path, q.url as right_path, regexp_replace(regexp_extract(p.url, '[^/]*$'), '\\.[^.]*$', '') as name
       from pages p join (select 'masks/' || regexp_replace(regexp_extract(url, '[^/]*$'), '\\.[^.]*$', '') || '.png' as url from pages group by 1) q
       on regexp_replace(regexp_extract(p.url, '[^/]*$'), '\\.[^.]*$', '') = regexp_replace(regexp_extract(q.url, '[^/]*$'), '\\.[^.]*$', '')""",
)
def _(t):
    from millrace.functions.text import base_name, stem

    left = t.pages.select("url")
    right = left.select(F.concat(F.lit("masks/"), stem(base_name(F.col("url"))), F.lit(".png")).alias("url")).distinct()
    return joins.pair_by_name(left, right, "url")


# --- sets and order -------------------------------------------------------------------------

@query("append_union", "select * from orders where o_orderstatus = 'F' union all select * from orders where o_totalprice > 100000")
def _(t):
    return sets.append(t.orders.where("o_orderstatus = 'F'"), t.orders.where("o_totalprice > 100000"))


@query(
    "append_missing_cols",
    """select c_custkey as id, c_name as name, c_mktsegment as segment, null as balance from customer
       union all select s_suppkey, s_name, null, s_acctbal from supplier""",
)
def _(t):
    a = t.customer.selectExpr("c_custkey as id", "c_name as name", "c_mktsegment as segment")
    return sets.append(a, t.supplier.selectExpr("s_acctbal as balance", "s_name as name", "s_suppkey as id"))


@query("distinct_keep_first", "select event_type, min(event_id) as first_position from events group by 1")
def _(t):
    return sets.distinct_keep_first(t.events, "event_type", "event_id")


@query("distinct_values", "select distinct nullif(l_discount, 0.0) as d from lineitem")
def _(t):
    return sets.distinct_values(t.lineitem.select(F.expr("nullif(l_discount, 0.0D)").alias("d")), "d")


@query("head_n", "select o_orderkey, o_orderdate from orders order by o_orderdate, o_orderkey limit 5")
def _(t):
    return sets.head(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"])


@query(
    "topk_importance",
    """select feature, round(weight, 4) as weight from (select p_brand || ' ' || p_type as feature, sum(p_retailprice) as weight from part group by 1)
       order by weight desc, feature limit 50""",
)
def _(t):
    weights = t.part.groupBy(F.concat_ws(" ", "p_brand", "p_type").alias("feature")).agg(
        F.round(F.sum("p_retailprice"), 4).alias("weight")
    )
    return sets.top_k(weights, "weight", "feature", 50)


@query("sorted_classes", "select distinct cast(p_size as varchar) as class from part order by 1")
def _(t):
    return sets.sorted_classes(t.part, "p_size")


# --- SQL text over named tables -------------------------------------------------------------

def _sql(key, text):
    @query(key, text)
    def _(t):
        from millrace.sources.sql import run_sql

        names = [n for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem") if n in text]
        return run_sql(t.spark, text, {n: getattr(t, n) for n in names})


_sql(
    "sql_pricing_summary",
    """select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty,
              round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue,
              round(avg(l_discount), 6) as avg_disc, count(*) as n
       from lineitem where l_shipdate <= timestamp '2000-09-02 00:00:00'
       group by l_returnflag, l_linestatus order by l_returnflag, l_linestatus""",
)
_sql(
    "sql_top_customers",
    """select * from (
         select c_mktsegment, c_custkey, spent, row_number() over (partition by c_mktsegment order by spent desc, c_custkey) as place
         from (select c_mktsegment, c_custkey, round(sum(o_totalprice), 2) as spent
               from customer join orders on c_custkey = o_custkey group by c_mktsegment, c_custkey) s) r
       where place <= 10""",
)
_sql(
    "sql_rollup_sales",
    """select n_name, o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total
       from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
       group by rollup (n_name, o_orderstatus)""",
)
_sql(
    "sql_region_revenue",
    """select r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(distinct o_custkey) as customers
       from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey
            join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
       group by r_name""",
)
