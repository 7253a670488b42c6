"""Gradient boosting queries whose splits, leaves and codes SQL can work out."""

import math

from pyspark.sql import functions as F

from millrace.operators import gradient, ordered_targets
from millrace.plans.aggregates import rounded
from millrace.plans.registry import query

#: Few distinct values each, one of them often missing.
_FEATURES = ("quantity", "discount", "tax")
_ROWS = """select l_extendedprice as price, (l_returnflag = 'R')::int as returned,
  case when l_orderkey % 5 = 0 then null else l_quantity end as quantity, l_discount as discount, l_tax as tax from lineitem"""


def _level(source, out):
    """SQL for the best split of each node in ``source(node, g, h, f, x)``, with the sums of both sides."""
    return f"""{out}_bins as (select node, f, x, sum(g) as g, sum(h) as h from {source} group by all),
    {out}_node as (select node, sum(g) as tg, sum(h) as th from {source} where f = 0 group by all),
    {out}_cum as (
      select node, f, x, sum(g) over w as lg, sum(h) over w as lh from {out}_bins where x is not null
      window w as (partition by node, f order by x)),
    {out}_side as (
      select c.node, c.f, c.x, way.missing_left, lg + case when way.missing_left then coalesce(b.g, 0) else 0 end as lg,
        lh + case when way.missing_left then coalesce(b.h, 0) else 0 end as lh, tg, th
      from {out}_cum c join {out}_node using (node) left join {out}_bins b on b.node = c.node and b.f = c.f and b.x is null,
        (values (true), (false)) way(missing_left)),
    {out} as (
      select * from (select *, lg * lg / (lh + 1) + (tg - lg) * (tg - lg) / (th - lh + 1) - tg * tg / (th + 1) as gain from {out}_side where lh >= 1 and th - lh >= 1)
      qualify row_number() over (partition by node order by gain desc, f, x, missing_left desc) = 1)"""


def _tree_sql(g, h):
    return f"""with r as ({_ROWS}),
    l0 as (
      select 0 as node, {g} as g, {h} as h, unnest([0, 1, 2]) as f, unnest(v) as x, v
      from (select *, [quantity::double, discount::double, tax::double] as v from r)),
    {_level('l0', 's0')},
    l1 as (
      select case when coalesce(l0.v[s0.f + 1] <= s0.x, s0.missing_left) then 1 else 2 end as node, l0.g, l0.h, l0.f, l0.x from l0, s0),
    {_level('l1', 's1')},
    ends as (
      select n.node, n.tg, n.th, s.lg, s.lh, s.f, s.x, s.missing_left, coalesce(s.gain > 1e-9, false) as split
      from (from s0_node union all from s1_node) n left join (from s0 union all from s1) s using (node))
    select node, case when split then ['quantity', 'discount', 'tax'][f + 1] end as feature, case when split then round(x, 4) end as cut,
      case when split then missing_left::int end as missing_left, null::double as weight from ends
    union all select 2 * node + 1, null, null, null, round(case when split then -lg / (lh + 1) else -tg / (th + 1) end, 4) from ends where node > 0
    union all select 2 * node + 2, null, null, null, round(case when split then -(tg - lg) / (th - lh + 1) else -tg / (th + 1) end, 4) from ends where node > 0"""


def _tree(t, target, kind):
    missing = F.when(F.col("l_orderkey") % 5 != 0, F.col("l_quantity"))
    rows = t.lineitem.select(missing.alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), target.alias("y"))
    _, ((tree,),) = gradient.fit_trees(rows, F.col("y"), _FEATURES, kind, rounds=1, depth=2, rate=1.0, base=0.0)
    whole = (None, None, None, None)  # a node that no split improves
    splits = [(n, *((_FEATURES[tree.feature[n]], float(tree.cut[n]), bool(tree.missing_left[n]), None) if tree.cut[n] < math.inf else whole)) for n in range(3)]
    leaves = [(3 + n, None, None, None, float(w)) for n, w in enumerate(tree.leaf)]
    out = t.spark.createDataFrame(splits + leaves, "node long, feature string, cut double, missing_left boolean, weight double")
    return rounded(out, 4, "cut", "weight").withColumn("missing_left", F.col("missing_left").cast("int"))


@query("boost_second_order", _tree_sql("-price", "1.0"))
def _(t):
    """Splits, sides of missing values and leaves of the first tree for a number."""
    return _tree(t, F.col("l_extendedprice").cast("double"), "number")


@query("boost_second_order_class", _tree_sql("0.5 - returned", "0.25"))
def _(t):
    """The same for a class: gradients and Hessians of the logistic loss."""
    return _tree(t, (F.col("l_returnflag") == "R").cast("double"), "class")


@query(
    "boost_ordered_targets",
    """select o_orderkey, round((coalesce(sum(o_totalprice) over w, 0) + 2.0 * (select avg(o_totalprice) from orders)) / (count(*) over w + 2.0), 4) as code
       from orders window w as (partition by o_custkey order by md5('7|' || o_orderkey) rows between unbounded preceding and 1 preceding)""",
)
def _(t):
    """Each order's customer, coded by the prices of the orders before it in the hashed order."""
    coded = ordered_targets.ordered_codes(t.orders, ["o_orderkey"], "o_custkey", F.col("o_totalprice"), "code", weight=2.0, seed=7)
    return rounded(coded.select("o_orderkey", "code"), 4, "code")
