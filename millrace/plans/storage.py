"""Round trips through files, tables and cells, on data taken from the driver tables."""

from pyspark.sql import functions as F

from millrace.plans.aggregates import rounded
from millrace.plans.registry import query
from millrace.session import scratch_folder
from millrace.sources import files, tables
from millrace.sources.scripts import register_script
from millrace.sources.sql import run_sql


@query(
    "io_read_csv",
    """select p_partkey, case when p_partkey % 5 = 0 then null else p_size end as size, case when p_partkey % 3 = 0 then null else p_retailprice end as price,
              case when p_partkey % 7 = 0 then null else p_name end as name from part""",
)
def _(t):
    path = scratch_folder(t.spark, "parts")
    raw = t.part.selectExpr(
        "p_partkey", "case when p_partkey % 5 = 0 then 'NA' else cast(p_size as string) end as size",
        "case when p_partkey % 3 = 0 then '' else cast(p_retailprice as string) end as price",
        "case when p_partkey % 7 = 0 then 'null' else p_name end as name",
    )
    raw.write.option("header", True).option("sep", ";").csv(path)
    return files.read_delimited(t.spark, path, ";")


@query("io_regex_split", "select cast(c_custkey as varchar) as id, cast(c_nationkey as varchar) as nation, c_mktsegment as segment, cast(cast(floor(c_acctbal) as bigint) as varchar) as balance from customer")
def _(t):
    line = F.concat("c_custkey", F.lit("  "), "c_nationkey", F.lit(";"), "c_mktsegment", F.lit(","), F.floor("c_acctbal"))
    path = scratch_folder(t.spark, "lines")
    t.customer.select(line.alias("id nation;segment,balance")).write.options(header=True, quote="", sep="\x01").csv(path)
    return files.read_regex_delimited(t.spark, path)


@query("io_csv_roundtrip", "select o_orderkey, nullif(o_orderstatus, 'F') as status, o_totalprice from orders")
def _(t):
    path = scratch_folder(t.spark, "csv")
    df = t.orders.selectExpr("o_orderkey", "nullif(o_orderstatus, 'F') as status", "o_totalprice")
    files.write_csv(df, path)
    return files.read_delimited(t.spark, path, schema=df.schema)


@query("io_json_roundtrip", "select event_id, user_id, nullif(event_type, 'view') as kind, value from events")
def _(t):
    path = scratch_folder(t.spark, "json")
    df = t.events.selectExpr("event_id", "user_id", "nullif(event_type, 'view') as kind", "value")
    files.write_json(df, path, compression="bzip2")
    return files.read_json(t.spark, path, df.columns, df.schema)


@query("io_object_store", "select s_suppkey, s_acctbal from supplier")
def _(t):
    df = t.supplier.select("s_suppkey", "s_acctbal")
    path = files.write_object_store(df, scratch_folder(t.spark, "objects"))
    return files.read_delimited(t.spark, path, schema=df.schema)


@query("export_partitioned", "select c_custkey, c_acctbal, c_mktsegment as segment from customer")
def _(t):
    path = scratch_folder(t.spark, "by-class")
    files.export_by_value(t.customer.selectExpr("c_custkey", "c_acctbal", "c_mktsegment as segment"), "segment", path)
    return t.spark.read.option("header", True).schema("c_custkey bigint, c_acctbal double, segment string").csv(path)


@query("io_labelled_files", "select distinct 'c_mktsegment=' || c_mktsegment as label, dense_rank() over (order by c_mktsegment) - 1 as label_id from customer")
def _(t):
    path = scratch_folder(t.spark, "files")
    files.export_by_value(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", path)
    found = files.read_labelled_binary(t.spark, path, "*.csv")
    return found.select("label", "label_id").distinct()


@query("io_inventory_sync", "select distinct 'lang=' || lang as folder from documents where lang <> 'en'")
def _(t):
    path = scratch_folder(t.spark, "inventory")
    files.export_by_value(t.documents.select("doc_id", "lang"), "lang", path)
    found = files.file_inventory(t.spark, path, "*.csv")
    have = found.where(F.col("relative_path").startswith("lang=en/"))
    todo = files.to_transfer(found, have)
    return todo.select(F.substring_index("relative_path", "/", 1).alias("folder")).distinct()


@query("io_folder_metrics", "select count(*) as lines from orders")
def _(t):
    path = scratch_folder(t.spark, "metrics")
    t.orders.select("o_orderkey").write.csv(path)
    return files.folder_metrics(t.spark, path, "2020-01-01 00:00:00", "*.csv").select("lines")


@query(
    "text_lines_labelled",
    """select 'lang=' || lang as label, line as text, count(*) as n from (select lang, unnest(string_split(text, chr(10))) as line from documents)
       where trim(line) <> '' group by all""",
)
def _(t):
    path = scratch_folder(t.spark, "text")
    t.documents.select("lang", F.col("text").alias("value")).where(F.col("value").isNotNull()).write.partitionBy("lang").text(path)
    lines = files.read_labelled_text(t.spark, path)
    return lines.groupBy("label", "text").agg(F.count("*").alias("n"))


@query("table_load_count", "select o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by 1")
def _(t):
    path = scratch_folder(t.spark, "load")
    files.write_csv(t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice"), path)
    name = "load_" + path.rsplit("-", 1)[-1]
    loaded = tables.create_and_load(
        t.spark, name, "id bigint, o_orderpriority string, price double", path, location=scratch_folder(t.spark, "table")
    )
    return rounded(loaded.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("price").alias("total")), 2, "total")


@query(
    "cells_pivot",
    "select cast(user_id as varchar) as rowkey, " + ", ".join(
        f"max_by(value, event_id) filter (event_type = '{k}') as \"last:{k}\"" for k in ("click", "error", "purchase", "signup", "view")
    ) + " from events group by 1",
)
def _(t):
    return tables.cells_pivot(_cells(t))


def _cells(t):
    return t.events.select(
        F.col("user_id").cast("string").alias("rowkey"), F.lit("last").alias("family"),
        F.col("event_type").alias("qualifier"), "value", F.col("event_id").alias("version"),
    )


@query(
    "cells_get",
    "select rowkey, family, qualifier, max_by(value, version) as value from (select cast(user_id as varchar) as rowkey, 'last' as family, event_type as qualifier, value, event_id as version from events union all select cast(user_id as varchar), 'last', 'view', 0.5, event_id + 1000000 from events where event_type = 'error') where rowkey = '8' group by all",
)
def _(t):
    cells = _cells(t)
    more = cells.where("qualifier = 'error'").withColumns(
        {"qualifier": F.lit("view"), "value": F.lit(0.5).cast("double"), "version": F.col("version") + 1000000}
    )
    return tables.get(tables.put(cells, more), "8")


@query(
    "geo_explode",
    """select s_name as name, cast(5 as bigint) as points, s_acctbal / 100 as x1, cast(s_nationkey as double) as y1, s_acctbal / 100 + 2 as x2, s_nationkey + 1.5 as y2 from supplier""",
)
def _(t):
    """Each supplier as a rectangular footprint."""
    x, y = F.col("s_acctbal") / 100, F.col("s_nationkey").cast("double")
    ring = F.array(*[F.array(a, b) for a, b in ((x, y), (x + 2, y), (x + 2, y + 1.5), (x, y + 1.5), (x, y))])
    feature = F.struct(
        F.lit("Feature").alias("type"), F.struct(F.col("s_name").alias("name")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
    )
    path = scratch_folder(t.spark, "geo")
    t.supplier.select(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features")).write.json(path)
    found = files.read_geojson(t.spark, path, lines=True)
    return found.select(F.col("properties")["name"].alias("name"), "points", "x1", "y1", "x2", "y2")


class _Sessions:
    """A user's script: how many sessions a key has, parted by pauses of more than ``pause`` seconds."""

    def __init__(self, pause=3600):
        self.pause, self.key, self.last, self.n = pause, None, None, 0

    def row(self, key, ts):
        if self.last is None or (ts - self.last).total_seconds() > self.pause:
            self.n += 1
        self.key, self.last = key, ts

    def end(self):
        return [(self.key, self.n)]


@query(
    "user_script",
    """select user_id, sum(opens)::bigint as sessions from (
         select user_id, (lag(ts) over w is null or ts > lag(ts) over w + interval 20000 seconds)::int as opens from events window w as (partition by user_id order by ts, event_id)
       ) group by 1 having sum(opens) > 2""",
)
def _(t):
    """A class of the user's, called by name in SQL, over ordered partitions of a table."""
    register_script(t.spark, "count_sessions", _Sessions, ["user_id", "ts"], "user_id long, sessions long", ["user_id"], ["ts", "event_id"])
    events = t.events.select("user_id", "event_id", "ts")
    return run_sql(t.spark, "select * from count_sessions(table(events), pause => 20000) where sessions > 2", {"events": events})
