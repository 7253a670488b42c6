"""Encoders, scalers and splits."""

from pyspark.sql import functions as F

from millrace.operators import encode, scale, split
from millrace.operators.joins import lookup, lookup_map
from millrace.plans.aggregates import rounded
from millrace.plans.registry import query

_PART = "select p_partkey, nullif(p_brand, 'Brand#7') as brand from part"


def _part(t):
    return t.part.select("p_partkey", F.expr("nullif(p_brand, 'Brand#7')").alias("brand"))


def _case(column, values, prefix):
    return ", ".join(f"cast(coalesce({column} = '{v}', false) as integer) as \"{prefix}_{v}\"" for v in values)


_BRANDS = sorted(f"Brand#{i}" for i in range(1, 26) if i != 7)
_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "encode_label",
    """select o_orderkey, (select count(distinct p) from (select o_orderpriority as p from orders) where p < o.o_orderpriority) as o_orderpriority,
              (select count(distinct s) from (select o_orderstatus as s from orders) where s < o.o_orderstatus) as o_orderstatus from orders o""",
)
def _(t):
    out, _maps = encode.encode(t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus"), "o_orderpriority, o_orderstatus")
    return out


@query("encode_high_cardinality", "select s.c_name, row_number() over (order by c_name) - 1 as code from customer s")
def _(t):
    codes = encode.label_codes(t.customer, "c_name", small_rows=100)
    return codes.withColumnRenamed("value", "c_name")


@query("encode_decode_roundtrip", f"select p_partkey, brand, p_type from part join ({_PART}) using (p_partkey)")
def _(t):
    df = _part(t).join(t.part.select("p_partkey", "p_type"), "p_partkey")
    coded, maps = encode.encode(df, ["brand", "p_type"])
    return encode.decode(coded, maps)


@query("dictionary_lookup", "select s_suppkey, n_name as s_nationkey, case n_regionkey when 0 then 'south' when 1 then 'west' end as side from supplier join nation on s_nationkey = n_nationkey")
def _(t):
    named = lookup(t.supplier.select("s_suppkey", "s_nationkey", F.col("s_nationkey").alias("side")), "s_nationkey", t.nation, "n_nationkey", "n_name")
    sided = lookup(named, "side", t.nation, "n_nationkey", "n_regionkey")
    return lookup_map(sided, "side", {0: "south", 1: "west"})


@query("onehot", f"select p_partkey, {_case('brand', _BRANDS, 'brand')}, cast(brand is null as integer) as brand_nan from ({_PART})")
def _(t):
    return encode.one_hot(_part(t), "brand")


@query("dummy_drop_first", f"select p_partkey, {_case('brand', _BRANDS[1:], 'brand')} from ({_PART})")
def _(t):
    return encode.dummy(_part(t), "brand")


@query("ordinal", f"select p_partkey, case when brand is not null then dense_rank() over (order by brand nulls last) end as brand from ({_PART})")
def _(t):
    return encode.ordinal(_part(t), "brand")


def _digits(base, width):
    return ", ".join(f"cast(o // {base ** (width - 1 - i)} % {base} as integer) as brand_{i}" for i in range(width))


_ORDINAL = f"select p_partkey, case when brand is not null then dense_rank() over (order by brand nulls last) else 0 end as o from ({_PART})"


@query("binary_encode", f"select p_partkey, {_digits(2, 5)} from ({_ORDINAL})")
def _(t):
    return encode.binary(_part(t), "brand")


@query("base_n_encode", f"select p_partkey, {_digits(3, 3)} from ({_ORDINAL})")
def _(t):
    return encode.base_n(_part(t), "brand", 3)


@query(
    "hash_encode",
    "select o_orderkey, "
    + ", ".join(f"cast(('0x' || substr(md5(o_orderpriority), 32, 1))::integer % 8 = {i} as integer) as o_orderpriority_{i}" for i in range(8))
    + " from orders",
)
def _(t):
    return encode.hash_encode(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority")


@query(
    "hash_encode_any",
    "select s_suppkey, "
    + ", ".join(f"cast((('0x' || md5(s_name))::uhugeint % 5) = {i} as integer) as s_name_{i}" for i in range(5))
    + " from supplier",
)
def _(t):
    return encode.hash_encode(t.supplier.select("s_suppkey", "s_name"), "s_name", 5)


@query(
    "target_encode",
    """with g as (select o_custkey, avg(o_totalprice) as m, count(*) as n from orders group by 1), p as (select avg(o_totalprice) as prior from orders)
       select o_orderkey, round(prior * (1 - 1 / (1 + exp(-(n - 10) / 3.0))) + m * (1 / (1 + exp(-(n - 10) / 3.0))), 3) as o_custkey, o_totalprice
       from orders join g using (o_custkey), p""",
)
def _(t):
    out = encode.target_encode(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", "o_totalprice", min_rows=10.0, smoothing=3.0)
    return rounded(out, 3, "o_custkey")


@query(
    "auto_encode_plan",
    """select * from (values ('p_type', 'Nominal', (select count(distinct p_type) from part), 'OneHot'), ('p_brand', 'Nominal', (select count(distinct p_brand) from part), 'Hash'),
       ('kind', 'Ordinal', (select count(distinct p_type) from part), 'Ordinal'), ('p_size', 'Ordinal', (select count(distinct p_size) from part), 'Binary')) v("column", category, cardinality, coding)""",
)
def _(t):
    df = t.part.withColumn("kind", F.col("p_type"))
    return encode.auto_encode_plan(df, {"p_type": "Nominal", "p_brand": "Nominal", "kind": "Ordinal", "p_size": "Ordinal"})


@query(
    "auto_encode",
    "select p_partkey, "
    + _case("p_type", ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"], "p_type")
    + ", "
    + ", ".join(f"cast(p_size // {2 ** (5 - i)} % 2 as integer) as p_size_{i}" for i in range(6))
    + " from part",
)
def _(t):
    return encode.auto_encode(t.part.select("p_partkey", "p_type", "p_size"), {"p_type": "Nominal", "p_size": "Ordinal"})


# --- scalers --------------------------------------------------------------------------------

@query(
    "scale_standard",
    """select l_orderkey, round((l_quantity - (select avg(l_quantity) from lineitem)) / (select stddev_pop(l_quantity) from lineitem), 6) + 0.0 as l_quantity,
              round((l_extendedprice - (select avg(l_extendedprice) from lineitem)) / (select stddev_pop(l_extendedprice) from lineitem), 6) + 0.0 as l_extendedprice from lineitem""",
)
def _(t):
    df = t.lineitem.select("l_orderkey", "l_quantity", "l_extendedprice")
    return rounded(scale.scale(df, ["l_quantity", "l_extendedprice"], "standard"), 6, "l_quantity", "l_extendedprice")


@query(
    "scale_robust",
    """with q as (select quantile_cont(l_extendedprice, 0.5) as m, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) as w,
                 quantile_cont(l_quantity, 0.5) as m2, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) as w2 from lineitem)
       select l_orderkey, round((l_quantity - m2) / w2, 6) as l_quantity, round((l_extendedprice - m) / w, 6) as l_extendedprice from lineitem, q""",
)
def _(t):
    df = t.lineitem.select("l_orderkey", "l_quantity", "l_extendedprice")
    return rounded(scale.scale(df, ["l_quantity", "l_extendedprice"]), 6, "l_quantity", "l_extendedprice")


@query(
    "scale_minmax",
    """select p_partkey, round((p_retailprice - (select min(p_retailprice) from part)) / (select max(p_retailprice) - min(p_retailprice) from part), 9) as p_retailprice, 0.0 as flat from part""",
)
def _(t):
    df = t.part.select("p_partkey", "p_retailprice", F.lit(3.0).alias("flat"))
    return rounded(scale.scale(df, ["p_retailprice", "flat"], "minmax"), 9, "p_retailprice")


@query(
    "scale_normalizer",
    """select l_orderkey, round(l_quantity / n, 9) as l_quantity, round(l_discount / n, 9) as l_discount, round(l_tax / n, 9) as l_tax
       from (select *, sqrt(l_quantity * l_quantity + l_discount * l_discount + l_tax * l_tax) as n from lineitem)""",
)
def _(t):
    names = ["l_quantity", "l_discount", "l_tax"]
    return rounded(scale.normalize_rows(t.lineitem.select("l_orderkey", *names), names), 9, *names)


@query(
    "scale_apply",
    """with f as (select avg(o_totalprice) as m, stddev_pop(o_totalprice) as s from orders where o_orderstatus = 'F')
       select o_orderkey, round((o_totalprice - m) / s, 6) as o_totalprice from orders, f where o_orderstatus = 'O'""",
)
def _(t):
    fit = scale.fit_scaler(t.orders.where("o_orderstatus = 'F'"), ["o_totalprice"], "standard")
    return rounded(fit.apply(t.orders.where("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice")), 6, "o_totalprice")


# --- splits ---------------------------------------------------------------------------------

@query(
    "split_train_test",
    """select o_orderkey, case when row_number() over (order by md5(cast(o_orderkey as varchar) || '|7')) <= ceil(count(*) over () * 0.3) then 'test' else 'train' end as part from orders""",
)
def _(t):
    return split.train_test_parts(t.orders.select("o_orderkey"), "o_orderkey", 0.7, seed=7)


@query(
    "split_stratified",
    """with r as (select doc_id, lang, row_number() over (partition by lang order by md5(cast(doc_id as varchar) || '|0')) as rn,
                         count(*) over (partition by lang) as n from documents)
       select doc_id, lang, case when rn <= floor(n * 0.6) then 'train' when rn <= floor(n * 0.8) then 'validation' else 'test' end as part from r""",
)
def _(t):
    return split.split_stratified(t.documents.select("doc_id", "lang"), "doc_id", "lang", (0.6, 0.2, 0.2))


@query(
    "split_nested",
    """with r as (select vec_id, row_number() over (order by md5(cast(vec_id as varchar) || '|1')) as rn, count(*) over () as n from embeddings)
       select vec_id, case when rn <= ceil(n * 0.2) then 'test' when rn <= ceil(n * 0.2) + ceil((n - ceil(n * 0.2)) * 0.25) then 'validation' else 'train' end as part from r""",
)
def _(t):
    return split.split_nested(t.embeddings.select("vec_id"), "vec_id", 0.2, 0.25, seed=1)
