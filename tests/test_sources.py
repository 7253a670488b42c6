import pytest
from conftest import rows
from pyspark.sql import functions as F

from millrace.functions import dates, logs, nested, text, vocab
from millrace.operators import encode, sessions, summary
from millrace.sources import files, jdbc, tables
from millrace.sources.sql import run_sql


def test_delimited_with_missing_spellings(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("a,b,c,d\n1,1.5,true,x\nNA,,false,null\n3,nan,TRUE,z\n")
    df = files.read_delimited(spark, str(p))
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "double", "boolean", "string"]
    assert rows(df) == [(1, 1.5, True, "x"), (3, None, True, "z"), (None, None, False, None)]


def test_regex_delimited(spark, tmp_path):
    p = tmp_path / "t.txt"
    p.write_text("id  name;x\n1 \"a\",2\n2;b   3\n")
    assert rows(files.read_regex_delimited(spark, str(p))) == [("1", '"a"', "2"), ("2", "b", "3")]


def test_typed_matrix_and_geo(spark, tmp_path):
    t = tmp_path / "bonds.txt"
    t.write_text("id\tface\tissue\nbond0\t50\t01/11/2018\nbond1\t51.5\t02/05/2019\n")
    df = files.read_typed(spark, str(t), "id string, face double, issue date")
    assert [str(r["issue"]) for r in df.orderBy("id").collect()] == ["2018-11-01", "2019-05-02"]
    m = tmp_path / "m.txt"
    m.write_text("1 0.5\n0.5  1\n")
    assert rows(files.read_matrix(spark, str(m))) == [(0, 0, 1.0), (0, 1, 0.5), (1, 0, 0.5), (1, 1, 1.0)]
    g = tmp_path / "g.json"
    g.write_text("""{"type": "FeatureCollection",
      "features": [{"type": "Feature", "properties": {"name": "p"}, "geometry": {"type": "Polygon",
       "coordinates": [[[-2, 1], [3, 1], [3, 4], [-2, 4], [-2, 1]]]}}]}""")
    r = files.read_geojson(spark, str(g)).first()
    assert (r["properties"]["name"], r["points"], r["x1"], r["y1"], r["x2"], r["y2"]) == ("p", 5, -2.0, 1.0, 3.0, 4.0)


def test_labelled_files(spark, tmp_path):
    for label, name, body in (("cat", "1.txt", "a\n \nb\n"), ("dog", "2.txt", "c\n"), ("dog", ".hidden", "x\n")):
        (tmp_path / label).mkdir(exist_ok=True)
        (tmp_path / label / name).write_text(body)
    found = files.read_labelled_binary(spark, str(tmp_path))
    assert rows(found.select("label", "label_id")) == [("cat", 0), ("dog", 1)]
    assert rows(files.read_labelled_text(spark, str(tmp_path))) == [("a", "cat"), ("b", "cat"), ("c", "dog")]
    assert {r["label"] for r in files.read_labelled_text(spark, str(tmp_path), labelled=False).collect()} == {"unlabeled"}
    assert rows(files.read_labelled_text(spark, str(tmp_path), label_from="file").select("label").distinct()) == [("1",), ("2",)]


def test_inventory(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "a.csv").write_text("1\n2\n")
    (tmp_path / "s" / "b.csv").write_text("3\n")
    (tmp_path / "empty.csv").write_text("")
    found = files.file_inventory(spark, str(tmp_path), "*.csv")
    assert rows(found.select("relative_path")) == [("a.csv",), ("s/b.csv",)]
    have = spark.createDataFrame([("a.csv",)], "relative_path string")
    assert rows(files.to_transfer(found, have).select("relative_path")) == [("s/b.csv",)]
    assert files.to_transfer(found, have, sync=False).count() == 2
    assert files.file_inventory(spark, str(tmp_path), "*.csv", recursive=False).count() == 1
    m = files.folder_metrics(spark, str(tmp_path), "2000-01-01 00:00:00", "*.csv").first()
    assert tuple(m) == (3, 6, 2, 3)


def test_database_options():
    db = jdbc.Database("greenplum", "h", "d", "u")
    assert db.options()["url"] == "jdbc:postgresql://h:5432/d" and "password" not in repr(db)
    assert jdbc.Database("oracle", "h", "d", "u").url() == "jdbc:oracle:thin:@//h:1521/d"
    assert jdbc.Database("sqlserver", "h", "d", "u", port=9).url() == "jdbc:sqlserver://h:9;databaseName=d"
    for bad in (("nope", "h", "d", "u"), ("mysql", "", "d", "u"), ("mysql", "h", "", "u"), ("mysql", "h", "d", "")):
        with pytest.raises(ValueError):
            jdbc.Database(*bad)
    with pytest.raises(ValueError):
        jdbc.jdbc_read(None, db)
    with pytest.raises(ValueError):
        jdbc.jdbc_write(None, db, "t", "truncate")


def test_tables_and_cells(spark, tmp_path):
    (tmp_path / "e.csv").write_text("ID,Name\n1,a\n2,b\n")
    for _ in range(2):  # loading replaces the content
        t = tables.create_and_load(spark, "people_x", "id int, name string", str(tmp_path / "e.csv"), location=str(tmp_path / "t"))
    assert tables.row_count(t).first()["n"] == 2
    spark.sql("DROP TABLE people_x")
    assert tables.inline_rows(spark, [("a", 1500.0), ("b", 1500.0)], "customer string, amount double").count() == 2
    cells = tables.inline_rows(
        spark, [("u1", "p", "name", "x", 1), ("u1", "p", "name", "y", 2), ("u2", "c", "tel", "7", 1)],
        "rowkey string, family string, qualifier string, value string, version int",
    )
    assert tables.get(cells, "u1", "p", "name").first()["value"] == "y"
    assert rows(tables.cells_pivot(cells)) == [("u1", None, "y"), ("u2", "7", None)]
    assert run_sql(spark, "select count(*) as n from c where version = 1", {"c": cells}).first()["n"] == 2
    with pytest.raises(ValueError):
        run_sql(spark, " ", {})


def test_write_readers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, None, 2.0)], "k int, s string, x double")
    files.write_csv(df, str(tmp_path / "c"))
    assert rows(files.read_delimited(spark, str(tmp_path / "c"), schema=df.schema)) == rows(df)
    files.write_json(df, str(tmp_path / "j"), compression="bzip2")
    assert rows(files.read_json(spark, str(tmp_path / "j"), ["x", "k"])) == [(2.0, 2), (None, 1)]
    a, b = (files.write_object_store(df, str(tmp_path / "o")) for _ in range(2))
    assert a != b


def test_log_lines(spark):
    rules = logs.read_rules(spark.createDataFrame(
        [(2, r"(\d+) (.*)", "date, rest"), (1, r"ERR (\w+) at (\d+)", "who, time"), (3, "x(y)?", "rest")], "id int, regex string, variables string"))
    assert [r[0] for r in rules] == [1, 2, 3] and logs.rule_columns(rules) == ["who", "time", "date", "rest"]
    lines = spark.createDataFrame([("err Bob at 235959",), ("011123  note ",), ("see err Bob at 235959",), ("1112",), ("11123 z",)], "value string")
    got = {r["value"]: r for r in logs.parse_log(lines, rules).collect()}
    assert (got["err Bob at 235959"]["who"], got["err Bob at 235959"]["time"]) == ("Bob", "23:59:59")
    assert str(got["011123  note "]["date"]) == "2023-11-01" and got["011123  note "]["rest"] == "note"
    assert got["see err Bob at 235959"]["pattern_id"] is None
    assert str(got["11123 z"]["date"]) == "2023-11-01"


def test_dates(spark):
    df = spark.createDataFrame([("310299",), ("1",), ("29022024",), (None,)], "d string")
    assert [str(r[0]) for r in df.select(dates.expand_date(F.col("d"))).collect()] == ["None", "None", "2024-02-29", "None"]
    days = dates.calendar_days(spark, "2024-02-26", "2024-03-04", "every_monday",
                               holidays=spark.sql("select date '2024-02-26' as day"), extras=spark.sql("select date '2024-02-27' as day"))
    assert [str(r["day"]) for r in days.orderBy("day").collect()] == ["2024-02-27", "2024-03-04"]
    with pytest.raises(ValueError):
        dates.calendar_days(spark, "2024-01-01", "2024-01-02", "sometimes")


def test_text(spark):
    one = spark.createDataFrame([(" a ,, 00b0 ", "http://u@h.x:80/p/q.tar.gz?a=1", "")], "l string, u string, e string")
    r = one.select(
        text.split_trim(F.col("l")).alias("some"), text.split_trim(F.col("l"), omit_empty=False).alias("all"),
        text.url_host(F.col("u")).alias("host"), text.url_port(F.col("u")).alias("port"), text.base64_decode(F.col("e")).alias("none"),
        text.extension(F.lit("a/b.tar.gz")).alias("ext"), text.parent_folder(F.lit("x/y/z.txt")).alias("dir"),
    ).first()
    assert (r["some"], r["all"], r["host"], r["port"], r["none"], r["ext"], r["dir"]) == (
        ["a", "00b0"], ["a", "", "00b0"], "h.x", 80, None, "gz", "y")
    lines = spark.createDataFrame([("a = 1", 1), ("a=2", 2), ("b = 1 = 2", 3), ("c", 4)], "l string, i int")
    assert rows(text.key_values(lines, "l", "i")) == [("a", "2")]
    assert rows(text.key_values(spark.createDataFrame([("k: v", 1)], "l string, i int"), "l", "i", ":")) == [("k", "v")]


def test_search_space(spark):
    doc = '[{"MODEL": "m1", "_comments": "x", "a": {"choice": ["1", "2"]}}, {"MODEL": "m2", "b": {"choice": ["3"]}}]'
    out = nested.search_space(spark.createDataFrame([(doc,)], "d string"), "d")
    assert rows(out.select("MODEL", "a", "b")) == [("m1", "1", None), ("m1", "2", None), ("m2", None, "3")]


def test_vocabulary(spark):
    df = spark.createDataFrame([("The cat the dog", "x"), ("a  cat\n", "x"), ("", "y")], "t string, l string")
    for small in (0, 1000):
        got = [(r["token"], r["n"], r["id"]) for r in vocab.text_vocab(df, "t", small).orderBy("id").collect()]
        assert got == [("cat", 2, 2), ("the", 2, 3), ("a", 1, 4), ("dog", 1, 5)]
    assert tuple(vocab.vocab_sizes(vocab.text_vocab(df, "t"), vocab.label_vocab(df, "l")).first()) == (6, 2)


def test_encoders_with_missing(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "v string")
    coded, maps = encode.encode(df, "v")
    assert rows(coded) == [(0,), (1,), (2,), (None,)]
    assert rows(encode.decode(coded, maps)) == rows(df)
    assert rows(encode.apply_codes(spark.createDataFrame([("zz",)], "v string"), "v", maps["v"])) == [(None,)]
    assert rows(encode.one_hot(df, "v")) == [(0, 0, 0, 1), (0, 0, 1, 0), (0, 1, 0, 0), (1, 0, 0, 0)]
    assert encode.dummy(df, "v").columns == ["v_b", "v_c"]
    assert rows(encode.binary(df, "v")) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert sum(rows(encode.hash_encode(df.where("v is null"), "v", 4))[0]) == 0


def test_sessions(spark):
    df = spark.createDataFrame(
        [("s1 s2", 1, "up", "x"), ("s1", 3, "down", "x"), ("s2  s3", 1, "up", None), (None, 2, "up", "y")], "s string, p int, st string, c string")
    out = sessions.session_features(df, "s", "p", ["st"], ["c"])
    assert out.columns == ["id", "pattern_1", "pattern_2", "pattern_3", "st=down", "st=up", "distinct_c"]
    assert rows(out) == [("s1", 1, 0, 1, 1, 1, 1), ("s2", 2, 0, 0, 0, 2, 1), ("s3", 1, 0, 0, 0, 1, 0)]


def test_profile(spark):
    df = spark.createDataFrame([(1.0, " "), (0.0, "a"), (float("nan"), None), (None, "a")], "x double, s string")
    got = {r["column"]: r for r in summary.profile(df, ["s"]).collect()}
    assert (got["x"]["max"], got["x"]["mean"], got["x"]["zeros"], got["x"]["missing"]) == (1.0, 0.5, 1, 2)
    assert (got["s"]["missing"], got["s"]["cardinality"], got["s"]["max"]) == (1, 2, None)
    steps = {r["column"]: r["one_step"] for r in summary.type_features(
        spark.createDataFrame([(1, 0.5, 1.0), (2, 1.5, 2.5), (3, 2.5, 3.0)], "a int, b double, c double")).collect()}
    assert steps == {"a": 1, "b": 1, "c": 0}


def test_label_conflicts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, None), (3, "a")], "k int, l string")
    assert rows(summary.label_conflicts(df, "k", "l").select("k")) == [(2,), (3,)]
