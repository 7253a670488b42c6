"""Grouped summaries, histograms, profiles, session vectors, metrics, drift and risk queries."""

from pyspark.sql import functions as F

from millrace.operators import drift, finance, metrics, sessions, summary
from millrace.operators.joins import align_by_id, scenario_grid, shock_range
from millrace.plans.registry import query


def rounded(df, digits, *names):
    """Round for comparison; adding 0.0 turns a negative zero into zero."""
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) + F.lit(0.0) for n in names})


# --- summaries ------------------------------------------------------------------------------

def _bin_sql(x, lo, hi, n):
    raw = f"least(floor(({x} - {lo}) / ({hi} - {lo}) * {n}), {n - 1})"
    step = f"(({hi} - {lo}) / {n})"
    return (
        f"cast(case when {hi} = {lo} then {n // 2} when {x} < {lo} + {raw} * {step} then {raw} - 1 "
        f"when {x} >= {lo} + ({raw} + 1) * {step} and {raw} < {n - 1} then {raw} + 1 else {raw} end as bigint)"
    )


def _histogram_sql(source, key, n, digits=9):
    """``source`` gives columns (``key``, x); an empty key means one group."""
    k = f"{key}, " if key else ""
    on = f"using ({key})" if key else "on true"
    on_bin = f"using ({key}, bin)" if key else "using (bin)"
    group = f"group by {key}" if key else ""
    return f"""
      with s as ({source}),
      r as (select {k} min(x) as lo, max(x) as hi, count(*) as total from s {group}),
      c as (select {k} {_bin_sql('x', 'lo', 'hi', n)} as bin, count(*) as n from s join r {on} group by all),
      e as (select {k} total, bin from r, (select unnest(generate_series(0, {n - 1})) as bin))
      select {k} bin, coalesce(n, 0) as n, round(coalesce(n, 0) / total, {digits}) as fraction from e left join c {on_bin}"""


def _moment_sql(x, p):
    m = f"(select 1)"
    return f"""
      case when min({x}) < max({x}) then round((avg({x}*{x}*{x}*{x}) - 4*avg({x})*avg({x}*{x}*{x}) + 6*avg({x})*avg({x})*avg({x}*{x}) - 3*power(avg({x}),4)) / power(avg({x}*{x}) - avg({x})*avg({x}), 2) - 3, 5) end as {p}_kurtosis,
      case when min({x}) < max({x}) then round((avg({x}*{x}*{x}) - 3*avg({x})*avg({x}*{x}) + 2*power(avg({x}),3)) / power(avg({x}*{x}) - avg({x})*avg({x}), 1.5), 5) end as {p}_skew,
      min({x}) as {p}_min, max({x}) as {p}_max, round(avg({x}), 6) as {p}_mean, round(quantile_cont({x}, 0.5), 6) as {p}_median"""


@query(
    "summarize_moments",
    f"""select o_orderstatus, {_moment_sql('t', 'price')}, {_moment_sql('w', 'day')}, min(label) as label
        from (select o_orderstatus, o_totalprice / 100000 as t, cast(extract(dow from o_orderdate) as double) as w,
                     case o_orderstatus when 'F' then 1 else 0 end as label from orders) group by 1""",
)
def _(t):
    df = t.orders.select(
        "o_orderstatus",
        (F.col("o_totalprice") / 100000).alias("price"),
        (F.dayofweek("o_orderdate") - 1).cast("double").alias("day"),
        F.expr("case o_orderstatus when 'F' then 1 else 0 end").alias("label"),
    )
    out = summary.summarize(df, "o_orderstatus", label="label")
    kept = out.select([c for c in out.columns if "_bin" not in c])
    stats = rounded(kept, 5, "price_kurtosis", "price_skew", "day_kurtosis", "day_skew")
    return rounded(stats, 6, "price_mean", "price_median", "day_mean", "day_median")


@query(
    "summarize_bins",
    f"""with h as ({_histogram_sql("select l_returnflag, l_extendedprice as x from lineitem", "l_returnflag", 10)})
        select l_returnflag, {", ".join(f"max(case when bin = {i} then fraction end) as l_extendedprice_bin{i}" for i in range(10))},
        (select round(median(l_extendedprice), 4) from lineitem m where m.l_returnflag = h.l_returnflag) as l_extendedprice_median
        from h group by l_returnflag""",
)
def _(t):
    out = summary.summarize(t.lineitem.select("l_returnflag", "l_extendedprice"), "l_returnflag")
    bins = [f"l_extendedprice_bin{i}" for i in range(10)]
    out = out.select("l_returnflag", *bins, "l_extendedprice_median")
    return rounded(rounded(out, 9, *bins), 4, "l_extendedprice_median")


@query("group_histogram", _histogram_sql("select l_suppkey, l_extendedprice as x from lineitem", "l_suppkey", 10))
def _(t):
    return rounded(summary.group_histogram(t.lineitem, ["l_suppkey"], "l_extendedprice"), 9, "fraction")


@query(
    "poly_histogram",
    _histogram_sql("select event_type, unnest([1.0, value, value * value]) as x from events", "event_type", 10),
)
def _(t):
    return rounded(summary.poly_histogram(t.events, ["event_type"], "value"), 9, "fraction")


@query(
    "profile_columns",
    """with s as (select nullif(l_discount, 0.0) as d, l_quantity as q, nullif(l_returnflag, 'A') as f, l_linenumber as n from lineitem)
       select 'd' as "column", max(d) as max, min(d) as min, round(avg(d), 3) as mean, count(*) filter (d = 0) as zeros, count(*) filter (d is null) as missing, null::bigint as cardinality from s
       union all select 'q', max(q), min(q), round(avg(q), 3), count(*) filter (q = 0), count(*) filter (q is null), null from s
       union all select 'f', null, null, null, null, count(*) filter (f is null), count(distinct f) + 1 from s
       union all select 'n', null, null, null, null, count(*) filter (n is null), count(distinct n) from s""",
)
def _(t):
    df = t.lineitem.selectExpr(
        "nullif(l_discount, 0.0D) as d", "l_quantity as q", "nullif(l_returnflag, 'A') as f", "l_linenumber as n"
    )
    return summary.profile(df, categorical=["f", "n"])


@query(
    "type_features",
    """with u as (
         select 'p_partkey' as "column", 0 as is_float, count(distinct p_partkey) as unique_values, cast(max(p_partkey) - min(p_partkey) = count(distinct p_partkey) - 1 as integer) as one_step from part
         union all select 'p_type', 0, count(distinct p_type), 1 from part
         union all select 'p_size', 0, count(distinct p_size), cast(max(p_size) - min(p_size) = count(distinct p_size) - 1 as integer) from part
         union all select 'p_retailprice', 1, count(distinct p_retailprice), 0 from part)
       select *, round((unique_values - (select avg(unique_values) from u)) / (select stddev_pop(unique_values) from u), 9) as unique_scaled from u""",
)
def _(t):
    return rounded(summary.type_features(t.part.select("p_partkey", "p_type", "p_size", "p_retailprice")), 9, "unique_scaled")


@query("value_counts", "select p_brand, count(*) as n from part group by 1")
def _(t):
    return summary.value_counts(t.part, "p_brand")


@query(
    "label_conflicts",
    """select c_nationkey, min(c_mktsegment) as first_label, max(c_mktsegment) as last_label from customer
       where c_custkey % 40 < 2 group by 1 having min(c_mktsegment) <> max(c_mktsegment)""".replace("where c_custkey % 40 < 2 ", ""),
)
def _(t):
    return summary.label_conflicts(t.customer, "c_nationkey", "c_mktsegment")


_LITERALS = """case event_id % 9 when 0 then cast(event_id as varchar) when 1 then 'NULL' when 2 then '12.50' when 3 then 'True'
  when 4 then '''' || event_type || '''' when 5 then '2024-01-02' when 6 then '10:20:30' when 7 then '2024-01-02T10:20:30' else '-' || event_type end"""


@query(
    "literal_types",
    f"""select case when regexp_full_match(x, '\\d+') then 'integer' when lower(x) = 'null' then 'null'
          when regexp_full_match(x, '\\d+\\.\\d+') then 'double' when lower(x) in ('true', 'false') then 'boolean'
          when x like '''%' then 'string' when regexp_full_match(x, '\\d{{4}}-\\d{{2}}-\\d{{2}}') then 'date'
          when regexp_full_match(x, '\\d{{2}}:\\d{{2}}:\\d{{2}}') then 'time'
          when regexp_full_match(x, '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}') then 'timestamp' else 'unsupported' end as type,
          count(*) as n from (select {_LITERALS} as x from events) group by 1""",
)
def _(t):
    call = F.expr(f"concat('p( ', {_LITERALS.replace('varchar', 'string').replace(chr(39) * 4, chr(34) + chr(39) + chr(34))}, ' )')")
    args = t.events.select(F.explode(summary.call_arguments(call)).alias("x"))
    return summary.literal_types(args, "x")


# --- charts ---------------------------------------------------------------------------------

@query(
    "chart_histogram",
    f"select bin, n from ({_histogram_sql('select o_totalprice as x from orders', '', 20)})",
)
def _(t):
    return summary.chart_histogram(t.orders, "o_totalprice")


@query(
    "chart_box",
    """select l_shipmode_, min(x) as low, round(quantile_cont(x, 0.25), 4) as q1, round(quantile_cont(x, 0.5), 4) as median,
              round(quantile_cont(x, 0.75), 4) as q3, max(x) as high
       from (select l_linenumber as l_shipmode_, l_extendedprice as x from lineitem) group by 1""".replace("l_shipmode_", "line"),
)
def _(t):
    df = t.lineitem.select(F.col("l_linenumber").alias("line"), "l_extendedprice")
    return rounded(summary.chart_box(df, ["line"], "l_extendedprice"), 4, "q1", "median", "q3")


@query("chart_pie", "select event_type, count(*) as n, round(count(*) / (select count(*) from events), 9) as share from events group by 1")
def _(t):
    return rounded(summary.chart_pie(t.events, "event_type"), 9, "share")


@query(
    "chart_heatmap",
    "select p_brand, "
    + ", ".join(f"count(*) filter (p_type = '{v}') as \"{v}\"" for v in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"))
    + " from part group by 1",
)
def _(t):
    return summary.chart_heatmap(t.part, "p_brand", "p_type")


# --- session vectors ------------------------------------------------------------------------

_LINES = """select cast(user_id as varchar) || case when event_id % 3 = 0 then '  u' || cast(user_id % 10 as varchar) else '' end as ids,
  cast(case event_type when 'click' then 1 when 'view' then 2 when 'error' then 4 else 5 end as bigint) as pattern,
  case when value < 50 then 'low' when value < 100 then 'mid' else 'high' end as level,
  event_type, nullif(cast(floor(value) % 7 as integer), 3) as code from events"""
_IDS = f"select unnest(list_filter(string_split(ids, ' '), lambda x: x <> '')) as id, * exclude (ids) from ({_LINES})"


def _lines(t):
    text = _LINES.replace("varchar", "string").replace(" from events", "").replace("select ", "", 1)
    return t.events.selectExpr(*_split_top(text))


def _split_top(text):
    """Top-level commas of a select list."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        depth += ch == "("
        depth -= ch == ")"
        if ch == "," and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


_PATTERNS = ", ".join(f"count(*) filter (pattern = {i}) as pattern_{i}" for i in range(1, 6))
_STATES = ", ".join(f"count(*) filter (level = '{v}') as \"level={v}\"" for v in ("high", "low", "mid"))
_DISTINCT = "count(distinct event_type) as distinct_event_type, count(distinct code) as distinct_code"


@query("pattern_counts", f"select id, {_PATTERNS} from ({_IDS}) group by 1")
def _(t):
    return sessions.pattern_counts(_lines(t), "ids", "pattern")


@query("state_counts", f"select id, {_STATES} from ({_IDS}) group by 1")
def _(t):
    return sessions.state_counts(_lines(t), "ids", ["level"])


@query("session_distinct", f"select id, {_DISTINCT} from ({_IDS}) group by 1")
def _(t):
    return sessions.session_distinct(_lines(t), "ids", ["event_type", "code"])


@query("session_features", f"select id, {_PATTERNS}, {_STATES}, {_DISTINCT} from ({_IDS}) group by 1")
def _(t):
    return sessions.session_features(_lines(t), "ids", "pattern", ["level"], ["event_type", "code"])


@query(
    "align_features",
    f"""select id, pattern_1, pattern_2, "level=high" from (select id, count(*) filter (pattern = 1) as pattern_1, count(*) filter (pattern = 2) as pattern_2 from ({_IDS}) where pattern < 3 group by 1)
        full outer join (select id, count(*) filter (level = 'high') as "level=high" from ({_IDS}) where level <> 'low' group by 1) using (id)""",
)
def _(t):
    lines = _lines(t)
    a = sessions.pattern_counts(lines.where("pattern < 3"), "ids", "pattern", patterns=2)
    b = sessions.state_counts(lines.where("level <> 'low'"), "ids", {"level": ["high"]})
    return align_by_id([a, b], "id")


# --- metrics --------------------------------------------------------------------------------

_SCORED = """select doc_id, lang, quality as label, cast(n_chars > 1000 as integer) as predictions, n_chars as score
  from labels join documents using (doc_id)"""


def _scored(t):
    return t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id").select(
        "doc_id", "lang", F.col("quality").alias("label"), (F.col("n_chars") > 1000).cast("int").alias("predictions"),
        F.col("n_chars").alias("score"),
    )


def _clusters(t):
    """Cluster guess: place of the largest of all components, modulo ten."""
    whole = F.transform("embedding", lambda x: x.cast("double"))
    guess = ((F.array_position(whole, F.array_max(whole)) - 1) % 10).cast("int")
    return t.embeddings.select("vec_id", "label", guess.alias("predictions"))


_CLUSTERS = "select vec_id, label, cast((list_position(embedding, list_max(embedding)) - 1) % 10 as integer) as predictions from embeddings"


@query("confusion_counts", f"select label, predictions as prediction, count(*) as n from ({_CLUSTERS}) group by all")
def _(t):
    return metrics.confusion_counts(_clusters(t), "label")


@query(
    "confusion_matrix",
    f"select label, {', '.join(f'count(*) filter (predictions = {i}) as pred_{i}' for i in range(10))} from ({_CLUSTERS}) group by 1",
)
def _(t):
    return metrics.confusion_matrix(_clusters(t), "label")


@query(
    "classification_scores",
    f"select round(avg(cast(label = predictions as integer)), 9) as accuracy, round(avg(cast(label = predictions as integer)), 9) as micro_precision, count(*) as n from ({_CLUSTERS})",
)
def _(t):
    return rounded(metrics.classification_scores(_clusters(t), "label"), 9, "accuracy", "micro_precision")


@query(
    "regression_scores",
    """with e as (select l_extendedprice / 1000 as y, l_quantity * 1.5 as p from lineitem)
       select round(avg((y - p) * (y - p)), 6) as mse, round(avg(abs(y - p)), 6) as mae,
              round(1 - sum((y - p) * (y - p)) / (count(*) * var_pop(y)), 6) as r2 from e""",
)
def _(t):
    df = t.lineitem.select((F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") * 1.5).alias("p"))
    return rounded(metrics.regression_scores(df, "y", "p"), 6, "mse", "mae", "r2")


@query(
    "clustering_scores",
    f"""with c as (select label, predictions, count(*) as nij from ({_CLUSTERS}) group by all),
        a as (select label, sum(nij) as a from c group by 1), b as (select predictions, sum(nij) as b from c group by 1),
        n as (select sum(nij) as n from c),
        mi as (select sum(nij / n * ln(nij * n / (a * b))) as mi from c join a using (label) join b using (predictions), n),
        ha as (select -sum(a / n * ln(a / n)) as ha from a, n), hb as (select -sum(b / n * ln(b / n)) as hb from b, n)
        select round(mi, 6) as mutual_info, round(mi / ha, 6) as homogeneity, round(mi / hb, 6) as completeness,
               round(2 * (mi / ha) * (mi / hb) / (mi / ha + mi / hb), 6) as v_measure from mi, ha, hb""",
)
def _(t):
    names = ("mutual_info", "homogeneity", "completeness", "v_measure")
    return rounded(metrics.clustering_scores(_clusters(t), "label").select(*names), 6, *names)


@query(
    "adjusted_mutual_info",
    f"""with c as (select label, predictions, count(*) as nij from ({_CLUSTERS}) group by all), n as (select sum(nij)::double as n from c),
        a as (select label, sum(nij)::double as a from c group by 1), b as (select predictions, sum(nij)::double as b from c group by 1),
        mi as (select sum(nij / n * ln(nij * n / (a * b))) as mi from c join a using (label) join b using (predictions), n),
        h as (select (select -sum(a / n * ln(a / n)) from a, n) as hu, (select -sum(b / n * ln(b / n)) from b, n) as hv),
        k as (select a, b, n, unnest(range(greatest(1, a + b - n)::bigint, least(a, b)::bigint + 1)) as k from a, b, n),
        e as (select sum(k / n * ln(n * k / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(n - a + 1) + lgamma(n - b + 1) - lgamma(n + 1)
                     - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(n - a - b + k + 1))) as e from k)
        select round((mi - e) / ((hu + hv) / 2 - e), 6) as adjusted_mutual_info from mi, h, e""",
)
def _(t):
    return rounded(metrics.adjusted_mutual_info(_clusters(t), "label"), 6, "adjusted_mutual_info")


@query(
    "roc_points",
    f"""with s as ({_SCORED}), g as (select score, count(*) filter (label = 1) as p, count(*) filter (label <> 1) as q from s group by 1)
        select cast(score as double) as threshold,
               round(sum(q) over (order by score desc) / (select count(*) from s where label <> 1), 9) as fpr,
               round(sum(p) over (order by score desc) / (select count(*) from s where label = 1), 9) as tpr from g
        union all select null, 0.0, 0.0""",
)
def _(t):
    return rounded(metrics.roc_points(_scored(t), "label", "score"), 9, "fpr", "tpr")


@query(
    "average_precision",
    f"""with g as (select lang, score, count(*) filter (label = 1) as pos, count(*) as n from ({_SCORED}) group by all),
        s as (select *, sum(pos) over w / sum(n) over w as precision from g window w as (partition by lang order by score desc)),
        e as (select *, max(precision) over (partition by lang order by score) as env from s)
        select lang, round(sum(pos * env) / sum(pos), 9) as ap from e group by 1""",
)
def _(t):
    return rounded(metrics.average_precision(_scored(t), ["lang"], "score", "label"), 9, "ap")


# --- drift and risk -------------------------------------------------------------------------

_KS = """with s as (select 'l_quantity' as "column", l_quantity as v, l_returnflag = 'A' as a from lineitem
                  union all select 'l_extendedprice', l_extendedprice, l_returnflag = 'A' from lineitem
                  union all select 'l_discount', case when l_returnflag = 'A' then l_discount else l_discount + 0.001 end, l_returnflag = 'A' from lineitem),
       g as (select "column", v, count(*) filter (a) as x, count(*) filter (not a) as y from s group by all),
       c as (select "column", sum(x) over w as cx, sum(y) over w as cy, sum(x) over (partition by "column") as nx, sum(y) over (partition by "column") as ny
             from g window w as (partition by "column" order by v)),
       d as (select "column", max(abs(cx / nx - cy / ny)) as d, max(nx) as n, max(ny) as m from c group by 1)
"""


def _ks(t):
    """Rows of one return flag against all others, one column a little moved."""
    columns = ["l_quantity", "l_extendedprice", "l_discount"]
    ref = t.lineitem.where("l_returnflag = 'A'").select(*columns)
    test = t.lineitem.where("l_returnflag <> 'A'").select(*columns).withColumn("l_discount", F.col("l_discount") + 0.001)
    return drift.ks_drift(ref, test, columns)


@query("ks_drift", _KS + """select "column", round(d, 9) as statistic, cast(n as bigint) as n_ref, cast(m as bigint) as n_test from d""")
def _(t):
    return rounded(_ks(t).select("column", "statistic", "n_ref", "n_test"), 9, "statistic")


@query(
    "ks_decision",
    _KS + """, p as (select "column", d * sqrt(n * m / (n + m)) as z from d),
       q as (select "column", case when z < 0.2 then 1.0 else least(greatest(
               list_sum(list_transform(range(1, 101), lambda k: (case when k % 2 = 1 then 2.0 else -2.0 end) * exp(-2.0 * k * k * z * z))), 0.0), 1.0) end as p from p)
       select "column", round(p, 9) as p_value, cast(p < 0.05 / 3 as integer) as drift from q""",
)
def _(t):
    return rounded(_ks(t).select("column", "p_value", "drift"), 9, "p_value")


_DAILY = "select date_trunc('day', ts) as day, event_type as asset, sum(value - 25) as pnl from events group by all"


def _daily(t):
    return t.events.groupBy(F.date_trunc("day", "ts").alias("day"), F.col("event_type").alias("asset")).agg(
        F.round(F.sum(F.col("value") - 25), 6).alias("pnl")
    )


@query(
    "var_es",
    """with q as (select event_type, quantile_cont(value - 25, 0.01) as v from events group by 1)
       select event_type, round(avg(value - 25), 6) as es, round(min(v), 6) as var
       from events join q using (event_type) where value - 25 <= v group by 1""",
)
def _(t):
    df = t.events.select("event_type", (F.col("value") - 25).alias("pnl"))
    return rounded(finance.var_es(df, ["event_type"], "pnl"), 6, "es", "var")


@query(
    "var_incremental",
    f"""with d as ({_DAILY}), total as (select day, sum(pnl) as total from d group by 1), names as (select distinct asset from d),
        rest as (select asset, total, total - coalesce(pnl, 0) as rest from total cross join names left join d using (day, asset))
        select asset, round(quantile_cont(total, 0.05), 5) as var_all, round(quantile_cont(rest, 0.05), 5) as var_without,
               round(quantile_cont(total, 0.05) - quantile_cont(rest, 0.05), 5) as var_incremental from rest group by 1""",
)
def _(t):
    out = finance.var_incremental(_daily(t), "day", "asset", "pnl", 0.95)
    return rounded(out, 5, "var_all", "var_without", "var_incremental")


@query("pnl_histogram", _histogram_sql("select value - 25 as x from events", "", 50))
def _(t):
    return rounded(finance.pnl_histogram(t.events.select((F.col("value") - 25).alias("pnl")), "pnl"), 9, "fraction")


@query(
    "cube_stats",
    """with b as (select p_retailprice as face, p_size / 1000 as coupon, (date '2018-05-01' + to_months((p_partkey % 240 + 1)::integer))::date as maturity from part),
       g as (select b.*, d as eval_date, s as shock from b, unnest([date '2018-12-01', date '2019-01-01', date '2019-02-01', date '2019-03-01']) t(d), unnest([0.0::double, 0.05, 0.1]) u(s)),
       v as (select *, greatest(date_diff('month', eval_date, maturity) / 12, 0) as years, coupon + shock as rate from g),
       p as (select eval_date, shock, case when years > 0 then face / pow(1 + rate, years)
               + list_sum(list_transform(range(0, ceil(years)::bigint), lambda k: face * coupon / pow(1 + rate, years - k))) else 0 end as pv from v)
       select eval_date, shock, round(sum(pv), 4) as total, round(avg(pv), 4) as mean, round(stddev_pop(pv), 4) as std, count(*) as n from p group by all""",
)
def _(t):
    """Every part read as a bond: price as face value, size in percent as coupon, 1-20 years to run."""
    bonds = t.part.select(
        "p_partkey", F.col("p_retailprice").alias("face"), (F.col("p_size") / 1000).alias("coupon"),
        F.expr("add_months(date '2018-05-01', cast(p_partkey % 240 + 1 as int))").alias("maturity"),
    )
    grid = scenario_grid(bonds, "2018-12-01", "2019-03-01", 1, shock_range(0, 0.1, 0.05))
    value = finance.bond_value(
        F.col("face"), F.col("coupon"), F.col("face"), F.col("eval_date"), F.col("maturity"), F.col("coupon") + F.col("shock")
    )
    return rounded(finance.cube_stats(grid.withColumn("pv", value), "pv"), 4, "total", "mean", "std")
