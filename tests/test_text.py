import re

from pyspark.sql import Row
from pyspark.sql import functions as F

from quarrylog import ordering
from quarrylog.functions import generate, text, time
from quarrylog.operators import access
from quarrylog.sources import ddl, logs


def _apply(spark, f, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.select(f(F.col("v")).alias("x"), "i").orderBy("i").select("x").collect()]


def test_templatize(spark):
    cases = {
        "SELECT a FROM t WHERE x = 'abc' AND y = 12": "SELECT a FROM t WHERE x = &&& AND y = #",
        "SELECT a12 FROM t_1 WHERE x='it''s' AND y=-1.5": "SELECT a1# FROM t_# WHERE x=&&&'s' AND y=#",
        "SELECT '7\\abc' , \"dq\" FROM t WHERE z=''": "SELECT @@@ , &&& FROM t WHERE z=&&&",
        "12 SELECT 5": "1# SELECT #",
        "SELECT x FROM t WHERE s='a\\'b' and q='z'": "SELECT x FROM t WHERE s=&&& and q=&&&",
        "SELECT 1e5, x1y2 IN ('a','b')": "SELECT #e5, x1y2 IN (&&&,&&&)",
        None: None,
        "": "",
    }
    assert _apply(spark, text.templatize, *cases) == list(cases.values())


def test_normalize(spark):
    cases = {
        "SELECT count(*) FROM  t WHERE a>=1 and b in ('x', 'y') and c IN (#,#) and d=Null": "SELECT count (*) FROM t WHERE a> =1 and b IN () and c IN () and d = #",
        "select nullable from t where x!=&&& and y<>#\n and z in ( select 1 )": "select #able from t where x! =# and y< ># and z IN ()",
        "UPDATE t SET a=#,b=&&&  WHERE (c=@@@)and d<=?x": "UPDATE t SET a = #, b = # WHERE (c = #) and d< =? x",
        "select f(g(h(1)))": "select f (g (h (1) ))",
    }
    assert _apply(spark, text.normalize_template, *cases) == list(cases.values())


def test_statement(spark):
    cases = {"INSERT INTO t SELECT a": "SELECT a", "Select x": None, "/*c*/ update t set selected=1": "selected=1", "BEGIN": None, "execute u: DELETE FROM t": "DELETE FROM t"}
    assert _apply(spark, text.statement_of, *cases) == list(cases.values())
    assert _apply(spark, text.has_statement, *cases) == [v is not None for v in cases.values()]


def test_anonymize_keeps_dates_numbers_and_patterns(spark):
    kept = ["select 1 where a = '2020-01-02' and b = '17' and c like 'x%'", "select 5"]
    assert _apply(spark, lambda c: text.anonymize(c, "s"), *kept) == kept
    (hidden,) = _apply(spark, lambda c: text.anonymize(c, "s"), "select 1 where a = 'secret'")
    assert "secret" not in hidden and "'6\\" in hidden


def test_bind_and_close(spark):
    rows = spark.createDataFrame([("a $1 b $10", ",".join(f"'v{i}'" for i in range(1, 11))), ("a $1", None)], "q string, p string")
    found = [r[0] for r in rows.select(text.close_statement(text.bind_parameters(F.col("q"), F.col("p")))).collect()]
    assert found == ["a 'v1' b 'v10';", "a $1;"]


def test_times(spark):
    assert _apply(spark, lambda c: time.parse(time.padded_hour(c), "mysql55").cast("string"), "170214  9:01:51", "960214 19:01:51", "x") == ["2017-02-14 09:01:51", "1996-02-14 19:01:51", None]


def test_records_from_lines(spark, tmp_path):
    (tmp_path / "a.log").write_text("2016-09-01T15:24:06.654226Z11 Query SELECT 1\n  FROM t\n2016-09-01T15:25:06.654226Z12 Quit \nlast")
    records = logs.assemble(logs.read_lines(spark, str(tmp_path)), "mysql57")
    parsed = {r.conn: (r.command, r.query) for r in logs.parse_mysql57(records).collect()}
    assert parsed == {"11": ("Query", "SELECT 1   FROM t"), "12": ("Quit", "last")}


def test_zip_lines(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("m.log", b"one\ntwo \xff")
    found = logs.read_zip_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [r.line for r in found] == ["one", "two �"]


def test_bad_rows_do_not_end_a_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"d","t","1","Query","select 1"\n"short"\n"d","t","2","Query","select ""2"", 3"\n')
    rows = logs.read_anonymised(spark, str(tmp_path), "mysql57").collect()
    assert [r.query for r in rows if r.rejected is None] == ["select 1", 'select "2", 3']
    assert sum(r.rejected is not None for r in rows) == 1


def test_ddl():
    found = ddl.parse("CREATE TABLE `a`.`b` (\n `MONKEY_ID` int(3),\n KEY x (y)\n);\nCREATE TABLE c(\n d text\n)")
    assert [(t, c, o) for t, c, o, _ in found] == [("a.b", "MONKEY_ID", 1), ("c", "d", 1)]


def test_dumps_are_scanned_across_blocks(spark, monkeypatch):
    dump = """-- x int
CREATE TABLE `a`.`b` (
  `MONKEY_ID` int(3) NOT NULL,
  KEY x (y),
  name character varying(5),
  e enum('p','q''s'), f ENUM ('z')
);
  stray int
create table IF NOT EXISTS c(
 d text
)
CREATE TABLE a.b (
 again double precision
"""
    rows = [(f, 10 * i, line) for f in ("one", "two") for i, line in enumerate(dump.splitlines())] + [("three", 5, "d int"), ("three", 6, None), ("three", 7, "")]
    lines = spark.createDataFrame(rows, "file string, line_no long, line string").repartition(5)
    want = [("a.b", "MONKEY_ID", 1, "INT"), ("a.b", "name", 2, "CHARACTER VARYING"), ("a.b", "e", 3, "ENUM"), ("c", "d", 1, "TEXT"), ("a.b", "again", 1, "DOUBLE PRECISION")]
    assert sorted(ddl.parse(dump)) == sorted(want)
    for width in (1 << 20, 15):
        monkeypatch.setattr(ddl, "BLOCK_LINES", width)
        assert sorted(map(tuple, ddl.scanned(lines).collect())) == sorted((f, *w) for f in ("one", "two") for w in want)
    tokens = {(r.token, r.literal) for r in ddl.scanned_literals(lines, "s").collect()}
    assert tokens == {(r.token, r.literal) for r in ddl.enum_tokens(spark, dump, "s").collect()} and len(tokens) == 4
    assert ddl.scanned(lines.filter("file = 'none'")).collect() == []


def test_large_dumps_are_scanned_in_small_tasks(spark, monkeypatch):
    monkeypatch.setattr(ddl, "BLOCK_LINES", 20)
    monkeypatch.setattr(ordering, "TASK_ROWS", 100, raising=False)
    dump = [line for t in range(300) for line in (f"CREATE TABLE t{t} (", " a int,", f" b{t} text,", " KEY k (a),", ");", "INSERT INTO t VALUES " + "(1)" * 50)]
    lines = spark.createDataFrame([("one", i, line) for i, line in enumerate(dump)], "file string, line_no long, line string").coalesce(1)
    got = ddl.scanned(lines).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r[:-1] for r in got) == sorted(("one", *c) for c in ddl.parse("\n".join(dump))) and len(got) == 600
    sizes = {t: sum(r.task == t for r in got) for t in {r.task for r in got}}
    assert len(sizes) > 10 and max(sizes.values()) <= 120


def test_dumps_with_odd_lines(spark):
    dump = ["a int", "CREATE TABLE `` (", " no int", "CREATE TABLE x (", None, " key int", " a int", " )", " b int", "CREATE TABLE y (", "  ) ", "CREATE TABLE z(", "c text"]
    lines = spark.createDataFrame([(f, i, line) for f in (None, "f") for i, line in enumerate(dump)], "file string, line_no int, line string")
    found = ddl.scanned(lines)
    assert sorted(map(str, found.collect())) == sorted(map(str, [r for f in (None, "f") for r in (Row(file=f, table="x", column="a", ordinal=1, data_type="INT"), Row(file=f, table="z", column="c", ordinal=1, data_type="TEXT"))]))


def test_access(spark):
    schema = spark.createDataFrame([("orders", "o_id"), ("orders", "o_c"), ("s.t", "a"), ("u", "b")], '"table" string, "column" string'.replace('"', "`"))
    cases = {
        "select * from orders x where x.o_c = param_holder and o_id>1 order by a": {("orders", "o_c"), ("orders", "o_id")},
        "select 1 from orders AS o join u on o.o_id=u.b where u.b=2 and o.o_c like 'x'": {("u", "b"), ("orders", "o_c")},
        "update s.t set a=1 where a=2": {("s.t", "a")},
        "update s.t q set a=1 where q.a=2 and t.a = 3": {("s.t", "a")},
        "select 1 from zz where a=1": set(),
        "select o_c from orders": set(),
        "SELECT 1 FROM `orders`, u as w WHERE w.`b` = 1 -- and o_c = 2\n and o_id = 'o_c'": {("u", "b"), ("orders", "o_id")},
        "select 1 from orders where o_c in (select b from u where u . b = 3) group by o_id": {("orders", "o_c"), ("u", "b")},
        "delete from orders where no_table.o_id = 1 /* where o_c */": {("orders", "o_id")},
        "select 1 from (select * from u) z, orders y where y.o_c = 1": {("orders", "o_c")},
        "": set(),
        None: set(),
    }
    templates = spark.createDataFrame([(t,) for t in cases] * 2, "template string")
    found = {}
    for r in access.access(templates, schema).collect():
        assert (r["table"], r["column"]) not in found.setdefault(r["template"], set())
        found[r["template"]].add((r["table"], r["column"]))
    assert found == {t: x for t, x in cases.items() if x}


def test_generated_values(spark):
    kinds = [("i", "tinyint", None), ("s", "VARCHAR", 7), ("t", "text", None), ("y", "YEAR", None), ("p", "POINT", None), ("x", "BOX", None), ("n", "no such type", None), ("f", "Double", None), ("z", "TIMESTAMP", None)]
    rows = generate.generated(spark, kinds, 200, text="words", year=1999).collect()
    assert {r.i for r in rows} == {0, 1} and all(len(r.s) == 7 and 0 <= r.f < 1 and r.t == "words" and r.y == 1999 and r.x == "NULL" and r.n is None and r.z for r in rows)
    assert all(re.fullmatch(r"\(\d+, \d+\)", r.p) for r in rows) and len({r.p for r in rows}) > 150
    member = generate.generators("", 0)["ENUM"]
    assert {r.e for r in spark.range(100).select(member(1, None, ("a", "b")).alias("e")).collect()} == {"a", "b"}


def test_csvlog_quotes_and_zones(spark):
    line = '2016-11-30 00:00:01.123 {z},"u","d",77,"h:1",5d.1,3,"idle",2016-11-30 00:00:00 {z},1/2,0,LOG,00000,"{q}","parameters: $1 = \'a""b\'",,,,,,,,"app"'
    records = [(1, line.format(z="EST", q='select ""a"",""b"" from t')), (2, line.format(z="UTC", q="select 1\nfrom t, u")), (3, line.format(z="EDT", q="")), (4, "no record"), (5, None)]
    df = spark.createDataFrame(records, "id int, record string")
    rows = {r.id: r for r in logs.parse_postgresql(df).collect()}
    assert {i: r.query for i, r in rows.items()} == {1: 'select "a","b" from t', 2: "select 1\nfrom t, u", 3: ""}
    assert all(r.params == "parameters: $1 = 'a\"b'" and r.conn == "77" for r in rows.values())
    assert sorted(r.id for r in logs.rejected(df, "postgresql").collect()) == [4, 5]


def test_files_in_splits_and_records_across_blocks(spark, tmp_path, monkeypatch):
    lines = [f"2016-09-01T15:24:06.{i:06}Z 11 Query SELECT {i}" if i % 4 == 0 else f"  more {i} é" for i in range(3000)]
    for name in ("a.log", "b.log"):
        (tmp_path / name).write_text("\r\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        read = logs.read_lines(spark, str(tmp_path)).collect()
        for name in ("a.log", "b.log"):
            mine = sorted((r.line_no, r.line) for r in read if r.file.endswith(name))
            assert [line for _, line in mine] == lines and len({n for n, _ in mine}) == len(lines)
        monkeypatch.setattr(logs, "BLOCK_LINES", 700)
        found = logs.assemble(logs.read_lines(spark, str(tmp_path)), "mysql57").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    expected = [" ".join(lines[i : i + 4]) for i in range(0, 3000, 4)]
    assert sorted(r.record for r in found) == sorted(expected * 2)
