"""Row-wise functions: logs, dates, text, JSON, maps and arrays."""

from pyspark.sql import functions as F

from millrace.functions import dates, logs, nested, text, vocab
from millrace.operators import series
from millrace.plans.aggregates import rounded
from millrace.plans.registry import query

_LINE = "strftime(ts, '%d%m%y %H%M%S') || ' ' || upper(event_type) || ' user=' || user_id || ' value ' || value"
_RULES = [
    (1, r"(\d+) (\d+) error user=(\d+) value ([\d.]+)", "date, time, user, amount"),
    (2, r"(\d+) (\d+) (click|view) user=(\d+)", "*, time, action, user"),
    (5, r"(\d+) .* value (\d+)\.", "date, whole"),
]


@query(
    "parse_log_rules",
    f"""with l as (select event_id, case when event_id % 11 = 0 then '# ' || ({_LINE}) else {_LINE} end as line, ts, event_type, user_id, value from events)
        select event_id,
          case when event_id % 11 = 0 or event_type in ('click', 'view') then null else strftime(ts, '%Y-%m-%d') end as date,
          case when event_id % 11 = 0 or event_type not in ('error', 'click', 'view') then null else strftime(ts, '%H:%M:%S') end as time,
          case when event_id % 11 = 0 or event_type not in ('error', 'click', 'view') then null else cast(user_id as varchar) end as user,
          case when event_id % 11 <> 0 and event_type = 'error' then cast(value as varchar) end as amount,
          case when event_id % 11 <> 0 and event_type in ('click', 'view') then upper(event_type) end as action,
          case when event_id % 11 <> 0 and event_type not in ('error', 'click', 'view') then cast(cast(floor(value) as bigint) as varchar) end as whole,
          case when event_id % 11 = 0 then null when event_type = 'error' then 1 when event_type in ('click', 'view') then 2 else 5 end as pattern_id
        from l""",
)
def _(t):
    line = F.concat(
        F.date_format("ts", "ddMMyy HHmmss"), F.lit(" "), F.upper("event_type"), F.lit(" user="), F.col("user_id"),
        F.lit(" value "), F.col("value"),
    )
    lines = t.events.select("event_id", F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("# "), line)).otherwise(line).alias("value"))
    return logs.parse_log(lines, _RULES).drop("value").withColumn("date", F.col("date").cast("string"))


@query("expand_dates", "select event_id, case event_id % 4 when 3 then null else strftime(ts, '%Y-%m-%d') end as day from events")
def _(t):
    raw = F.expr("""case event_id % 4 when 0 then date_format(ts, 'ddMMyy') when 1 then date_format(ts, 'ddMMyyyy')
                    when 2 then case when dayofmonth(ts) < 10 then substring(date_format(ts, 'ddMMyy'), 2) else date_format(ts, 'ddMMyy') end else 'x' end""")
    return t.events.select("event_id", dates.expand_date(raw).cast("string").alias("day"))


@query("parse_time", "select event_id, case when event_id % 5 = 0 then null else strftime(ts, '%H:%M:%S') end as at from events")
def _(t):
    raw = F.when(F.col("event_id") % 5 == 0, F.lit("256199")).otherwise(F.date_format("ts", "HHmmss"))
    return t.events.select("event_id", dates.parse_time(raw).alias("at"))


@query(
    "explode_ids",
    """select doc_id, w as id, count(*) as n from (select doc_id, unnest(string_split(replace(text, chr(10), ' '), ' ')) as w from documents) where w <> '' group by all""",
)
def _(t):
    df = t.documents.select("doc_id", F.regexp_replace("text", "\n", " ").alias("words"))
    return text.explode_ids(df, "words").groupBy("doc_id", "id").agg(F.count("*").alias("n"))


@query(
    "split_trim",
    """select doc_id, len(p) as parts, len(list_filter(p, lambda x: x <> '')) as kept, list_aggregate(list_transform(p, lambda x: length(x)), 'sum') as chars
       from (select doc_id, list_transform(string_split(replace(text, chr(10), ' '), ','), lambda x: trim(x)) as p from documents)""",
)
def _(t):
    line = F.regexp_replace("text", "\n", " ")
    return t.documents.select(
        "doc_id",
        F.size(text.split_trim(line, omit_empty=False)).cast("long").alias("parts"),
        F.size(text.split_trim(line)).cast("long").alias("kept"),
        F.aggregate(text.split_trim(line), F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"),
    )


@query(
    "url_parts",
    """select page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) as host, case when page_id % 3 = 0 then 8000 + page_id % 100 end as port from pages""",
)
def _(t):
    url = F.when(
        F.col("page_id") % 3 == 0,
        F.regexp_replace("url", r"^([a-z]+://[^/:?#]+)", F.concat(F.lit("$1:"), (8000 + F.col("page_id") % 100).cast("string"))),
    ).otherwise(F.col("url"))
    return t.pages.select("page_id", text.url_host(url).alias("host"), text.url_port(url).alias("port"))


@query("base64_roundtrip", "select page_id, base64(encode(url)) as code, url as back from pages")
def _(t):
    df = t.pages.select("page_id", text.base64_encode(F.col("url")).alias("code"))
    return df.withColumn("back", text.base64_decode(F.col("code")))


@query(
    "path_parts",
    """select page_id, regexp_extract(url, '[^/]*$') as name, regexp_extract(regexp_extract(url, '[^/]*$'), '\\.([^.]*)$', 1) as ext, regexp_extract(url, '([^/]*)/[^/]*$', 1) as folder from pages""",
)
def _(t):
    url = F.col("url")
    return t.pages.select("page_id", text.base_name(url).alias("name"), text.extension(url).alias("ext"), text.parent_folder(url).alias("folder"))


@query(
    "kv_lines",
    """select 'user.' || user_id as key, cast(max_by(event_id, event_id) as varchar) as value from events where event_id % 7 <> 0 group by 1""",
)
def _(t):
    line = F.expr("case when event_id % 7 = 0 then concat('user.', user_id, ' no pair') else concat('user.', user_id, ' =  ', event_id) end")
    return text.key_values(t.events.select("event_id", line.alias("line")), "line", "event_id")


@query(
    "truth_words",
    """select event_id, case event_id % 6 when 0 then 1 when 1 then 0 when 2 then 1 when 3 then 0 when 4 then 1 end as truth,
              case when event_id % 6 = 5 then 'invalid truth value ' || event_type end as error from events""",
)
def _(t):
    word = F.expr("case event_id % 6 when 0 then 'Yes' when 1 then 'off' when 2 then 'T' when 3 then '0' when 4 then 'ON' else event_type end")
    return text.with_truth(t.events.select("event_id", word.alias("word")), "word").drop("word").withColumn("truth", F.col("truth").cast("int"))


@query("json_props", "select event_id, cast(json_extract(props, '$.k') as bigint) as k, cast(json_extract(props, '$.k') as bigint) * 2 as twice from events")
def _(t):
    return t.events.select(
        "event_id",
        nested.json_field(F.col("props"), "$.k", "long").alias("k"),
        (F.try_element_at(nested.json_map(F.col("props"), "bigint"), F.lit("k")) * 2).alias("twice"),
    )


@query("map_invert", "select user_id, event_type, max(event_id) as last_event from events group by all")
def _(t):
    last = t.events.groupBy("user_id", "event_type").agg(F.max("event_id").alias("last_event"))
    per = last.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "last_event"))).alias("m"))
    return per.select("user_id", F.explode(nested.invert_map(F.col("m"))).alias("last_event", "event_type"))


@query(
    "array_stats",
    """select vec_id, cast(list_min(embedding) as double) as low, cast(list_max(embedding) as double) as high, len(embedding) as size,
              round(list_sum(list_transform(embedding, lambda x: x::double)), 6) as total, round(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 6) as energy from embeddings""",
)
def _(t):
    e = F.col("embedding")
    out = t.embeddings.select(
        "vec_id", F.array_min(e).cast("double").alias("low"), F.array_max(e).cast("double").alias("high"), F.size(e).cast("long").alias("size"),
        nested.array_sum(e).alias("total"), nested.array_sum(nested.array_product(e, e)).alias("energy"),
    )
    return rounded(out, 6, "total", "energy")


@query(
    "search_space_grid",
    """select b.p_brand as "MODEL", s.p_size as units, k.p_type as kind from (select distinct p_brand from part) b
       join (select distinct p_brand, cast(p_size as varchar) as p_size from part) s using (p_brand) join (select distinct p_brand, p_type from part) k using (p_brand)""",
)
def _(t):
    """One search space per brand, its choices the sizes and types that brand comes in."""
    choices = t.part.groupBy("p_brand").agg(
        F.collect_set(F.col("p_size").cast("string")).alias("s"), F.collect_set("p_type").alias("k")
    )
    doc = F.to_json(
        F.array(
            F.struct(
                F.col("p_brand").alias("MODEL"), F.lit("free text").alias("_comments"),
                F.struct(F.col("s").alias("choice")).alias("units"), F.struct(F.col("k").alias("choice")).alias("kind"),
            )
        )
    )
    return nested.search_space(choices.select(doc.alias("doc")), "doc", keys=["MODEL", "_comments", "units", "kind"])


@query("ratio_percent", "select l_orderkey, l_linenumber, round(l_tax / nullif(l_discount, 0) * 100, 6) as percent from lineitem")
def _(t):
    out = t.lineitem.select("l_orderkey", "l_linenumber", series.ratio_percent(F.col("l_tax"), F.col("l_discount")).alias("percent"))
    return rounded(out, 6, "percent")


# --- vocabularies ---------------------------------------------------------------------------

_TOKENS = "select lang, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) as token from documents"


@query(
    "text_vocab",
    f"select token, count(*) as n, row_number() over (order by count(*) desc, token) + 1 as id from ({_TOKENS}) group by 1",
)
def _(t):
    return vocab.text_vocab(t.documents, "text", small_rows=1_000)


@query(
    "vocab_sizes",
    f"select (select count(distinct token) + 2 from ({_TOKENS})) as vocab_size, (select count(distinct lang) from documents) as label_size",
)
def _(t):
    return vocab.vocab_sizes(vocab.text_vocab(t.documents, "text"), vocab.label_vocab(t.documents, "lang"))
