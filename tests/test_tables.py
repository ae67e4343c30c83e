"""Programs over tables: against SQL, against the evaluator, and their plans."""

from __future__ import annotations

import importlib.util
import os

import pytest
from pyspark.sql import functions as F

from sylva import api, queries
from sylva.functions.values import decode, sort_key
from sylva.operators.jq_eval import evaluate
from sylva.plans.jq_planner import NotPlanned

_spec = importlib.util.spec_from_file_location("compare", os.path.join(os.path.dirname(__file__), "compare.py"))
compare = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(compare)


@pytest.fixture(scope="module")
def con(sf):
    return compare.duck(sf)


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_matches_sql(spark, con, sf, name):
    assert compare.compare(spark, con, sf, queries.queries()[name], queries.oracle_sql()[name]) == ""


def explained(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in queries.QUERIES])
def test_typed_plans_run_no_python(spark, sf, name):
    plan = explained(queries.queries()[name](spark, sf))
    assert "Python" not in plan and "Arrow" not in plan


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = explained(api.jq(spark.read.parquet(f"{sf}/lineitem.parquet"), "map(select(.l_quantity > 45)) | map({l_orderkey})"))
    assert "l_comment" not in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_null_rows_and_order(spark):
    df = spark.createDataFrame([(1, None, "b"), (2, 5.0, "a"), (3, float("nan"), None), (4, 5.0, "a")], "id int, v double, s string")
    rows = [r.asDict() for r in df.collect()]
    for program in ("sort_by(.s) | map({id})", "group_by(.s) | map({s: .[0].s, n: length})", "min_by(.v) | {id}", "max_by(.s) | {id}", "unique_by(.s) | map({id})", "map(select(.v < 5)) | map({id})", "map({id, w: (.v // -1)})", "[.[] | .s // \"none\"] | unique | map({s: .})", ".[1:3] | map({id})", "map({id, a: (.s + \"x\")})", "first | {id}", "last | {id}", "reverse | map({id})"):
        got = [r.asDict() for r in api.jq(df, program, order=["id"]).collect()]
        want = evaluate(program, rows)[0]
        key = lambda r: sorted((k, compare.cell(v)) for k, v in r.items())
        assert sorted(map(key, got)) == sorted(map(key, want if isinstance(want, list) else [want])), program


def test_what_has_no_plan(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    with pytest.raises(NotPlanned):
        api.jq(df, "[limit(3; repeat(.))]")
    assert [r.value for r in api.jq(df, "[recurse(empty)] | length", mode="stream").collect()] == ["1"]


def test_documents_errors_and_keys(spark):
    df = spark.createDataFrame([(1, '{"a":[1,2]}'), (2, "[]"), (3, None), (4, "{bad")], "id int, doc string")
    out = {(r.id, r.position): (r.value, r.error) for r in api.jq_documents(df, "doc", ".a[]", keep=["id"]).collect()}
    assert out[1, 0] == ("1", None) and out[1, 1] == ("2", None) and "Cannot index array" in out[2, 0][1] and out[4, 0][0] is None and (3, 0) not in out
    values = ["1", "null", '"a"', "[2]", "false", "1.5", '{"a":1}', "-3"]
    keyed = api.sort_keys(spark.createDataFrame([(v,) for v in values], "doc string"), "doc").orderBy("sort_key")
    assert [r.doc for r in keyed.collect()] == sorted(values, key=lambda v: sort_key(decode(v)))


def test_yaml_columns(spark):
    df = spark.createDataFrame([(1, "a: 1 # x\nb: [2]\n"), (2, "a: [")], "id int, doc string")
    out = {r.id: r for r in api.yq_documents(df, "doc", ".a += 1", keep=["id"]).collect()}
    assert out[1].value == "a: 2 # x\nb: [2]\n" and out[2].error
    assert api.converted(df.filter("id = 1"), "doc", "yaml", "json").first().value == '{\n  "a": 1,\n  "b": [\n    2\n  ]\n}\n'


def test_readers_and_writers(spark, tmp_path):
    from sylva.sources import readers

    (tmp_path / "a.yml").write_text("a: 1\n---\na: 2\n")
    (tmp_path / "b.json").write_text('{"a":3}\n\n{"a":4}\n')
    docs = readers.documents(spark, f"{tmp_path}/*.yml")
    assert [(r.doc, r.document_index) for r in docs.orderBy("document_index").collect()] == [('{"a":1}', 0), ('{"a":2}', 1)]
    lines = readers.json_lines(spark, f"{tmp_path}/b.json")
    assert lines.count() == 2 and lines.first().filename.endswith("b.json")
    assert {(r.path, r.leaf) for r in readers.events(lines, "doc").collect()} == {('["a"]', "3"), ('["a"]', "4"), ('["a"]', None)}
    readers.write_split(lines.withColumn("name", F.lit("x")), "doc", "name", f"{tmp_path}/out")
    assert spark.read.text(f"{tmp_path}/out").count() == 2
    (tmp_path / "s.seq").write_text('\x1e{"a":1}\n\x1e[2]\n')
    assert readers.json_sequence(spark, f"{tmp_path}/s.seq").count() == 2


BAD = ["[" * 30_000, "a: " + "[" * 30_000, "{bad", "x", None, "", "<a>" * 20_000, "YQ=", "é\x00\ud7ff", "a = [[[", "=", "%zz", "k: *nowhere"]


@pytest.mark.parametrize("format_", ["yaml", "json", "csv", "tsv", "xml", "props", "toml", "hcl", "lua", "base64", "base64url", "uri", "kyaml"])
def test_no_document_ends_a_job(spark, format_):
    df = spark.createDataFrame(list(enumerate([*BAD, "{}"])), "id int, doc string")
    got = api.yq_documents(df, "doc", ".", format_, "json", keep=["id"]).collect()
    assert len(got) == len(BAD) + 1 and all((r.value is None) != (r.error is None) for r in got)


def test_no_document_ends_a_filter(spark):
    df = spark.createDataFrame(list(enumerate([*BAD, '{"a": 1}'])), "id int, doc string")
    got = {r.id: r for r in api.jq_documents(df, "doc", ".a", keep=["id"]).collect()}
    assert got[len(BAD)].value == "1" and all(r.error for k, r in got.items() if k < len(BAD))
    many = api.jq_documents(df.filter(f"id = {len(BAD)}"), "doc", "range(20000)", keep=["id"])
    assert sorted((r.position, r.value) for r in many.collect())[-1] == (19999, "19999") and many.count() == 20000


def test_sql_functions(spark):
    api.register(spark)
    (row,) = spark.sql("""SELECT jq('{"a":[1,2]}', '.a[]') AS x, jq('[', '.') AS bad, yq('a: 1', '.a += 1', 'yaml', 'json') AS y""").collect()
    assert row.x == ["1", "2"] and row.bad is None and "2" in row.y


def test_group_plans_read_what_they_use(spark, sf):
    plan = explained(queries.queries()["group_multi_key"](spark, sf))
    assert "l_orderkey" not in plan and "SortAggregate" not in plan and "l_comment" not in plan
    plan = explained(api.jq(spark.read.parquet(f"{sf}/lineitem.parquet"), "unique_by(.l_partkey) | map({l_partkey, l_tax})"))
    assert "l_shipdate" not in plan and "l_quantity" not in plan


def test_running_sums_and_places_against_the_evaluator(spark):
    rows = [(k, (k * 7919) % 13, None if k % 11 == 0 else (k * 31) % 17) for k in range(1500)]
    df = spark.createDataFrame(rows, "id int, g int, v int").repartition(5)
    data = [{"id": a, "g": b, "v": c} for a, b, c in rows]
    for program in ("[foreach .[] as $r (5; . + $r.g; {k: $r.id, t: .})]", "map(.id) | .[700:]", "map(.id) | .[3:-5]", "map(.id) | .[-9:-5]", "map(.id) | .[:-1490]", "sort_by(.v, .id) | to_entries | map({k: .key, id: .value.id})", "sort_by(.g) | reverse | to_entries | map({k: .key, id: .value.id})", "sort_by(-.id) | .[1490:] | map(.id)"):
        got = [r.asDict(True) for r in api.jq(df, program, order=["id"]).collect()]
        got = [r["value"] if list(r) == ["value"] else r for r in got]
        assert sorted(map(str, got)) == sorted(map(str, evaluate(program, data)[0])), program
    plain = spark.createDataFrame(rows, "id int, g int, v int").coalesce(1)
    got = [r.asDict() for r in api.jq(plain, "sort_by(.g) | to_entries | map({k: .key, id: .value.id})").collect()]
    assert sorted(map(str, got)) == sorted(map(str, evaluate("sort_by(.g) | to_entries | map({k: .key, id: .value.id})", data)[0]))
    empty = api.jq(df.limit(0), "to_entries | map({k: .key, id: .value.id})", order=["id"])
    assert empty.count() == 0
    plan = explained(api.jq(df, "[foreach .[] as $r (0; . + $r.g)]", order=["id"]))
    assert "hashpartitioning(__bucket" in plan and plan.count("SinglePartition") == 1  # the totals, a row a bucket


def test_semi_and_anti_joins_against_the_evaluator(spark):
    left, right = [(1, "a"), (2, None), (3, "b"), (4, "c")], [("a", 2), (None, 9), ("a", 0)]
    a, b = spark.createDataFrame(left, "id int, s string"), spark.createDataFrame(right, "s string, n int")
    rows, table = [{"id": i, "s": s} for i, s in left], [{"s": s, "n": n} for s, n in right]
    for program in ("select(.s | IN($t[].s))", "select(.s | IN($t[].s) | not)", "select(IN(.s; $t[].s))", "select(any($t[]; .n > 5))", "select(all($t[]; .n > 5))"):
        got = sorted(r.id for r in api.jq(a, f".[] | {program} | {{id}}", variables={"t": b}).collect())
        assert got == sorted(x["id"] for x in evaluate(f".[] | {program} | {{id}}", rows, variables={"t": table})), program


def test_streaming_sums_and_windows(spark, tmp_path):
    from sylva import streaming

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"k":"x","v":1,"t":"2024-01-01T00:00:10Z"}\n{"k":"y","v":2,"t":"2024-01-01T00:00:20Z"}\n{"k":"x","v":3,"t":"2024-01-01T00:01:10Z"}\n')
    rows = spark.readStream.schema("k string, v double, t timestamp").json(f"{tmp_path}/in")
    for name, df, mode in (("sums", streaming.running(rows, "k", "v"), "update"), ("windows", streaming.windowed(rows, "t", "1 minute", "10 minutes", ["k"], {"n": F.count(F.lit(1))}), "update")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
    assert sorted((r.key, r.total, r.n) for r in spark.sql("SELECT * FROM sums").collect()) == [("x", 4.0, 2), ("y", 2.0, 1)]
    assert spark.sql("SELECT k, n FROM windows").count() == 3


def test_streaming_filter(spark, tmp_path):
    from sylva import streaming

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"k":"x","v":1}\n{"k":"y","v":2}\n{"k":"x","v":3}\n')
    out = streaming.filtered(streaming.lines(spark, f"{tmp_path}/in"), "select(.v > 1) | .k")
    q = out.writeStream.format("memory").queryName("filtered").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.value for r in spark.sql("SELECT value FROM filtered").collect()) == ['"x"', '"y"']


PLANNED = """length;map(.n)|add;map(.v)|max;map(.n)|min;map(.n)|sort;map(.n)|unique;.[-1].id;first.id;last.id;map(.id)|.[2:];any(.n==7);map(.a)|flatten;map(.a[0]);[.[].a[0]]
map({id,l:(.a|length)});group_by(.g)|map(map(.id));group_by(.g)|map({g:.[0].g,ids:map(.id)});group_by(.n)|map({n:.[0].n,c:length});group_by(.g)|map(max_by(.v).id);group_by(.g)|.[]|length
unique_by(.n)|map(.id);sort_by(.g,.v)|map(.id);sort_by(-.id)|map(.id);sort_by(.v)|reverse|map(.id);[limit(2;.[])]|map(.id);map(.s//"none")|unique;reduce .[] as $r (0;.+$r.id)
[foreach .[] as $r (0;.+$r.id)];map(if .n>5 then "hi" else "lo" end);map(.id%2);map([.id,.n]|add);map(.g|test("x|y"));map(.a|first);map(.a|reverse);map(.n|=.+1)|map(.n);map(.z);map(.id as $x|.n|.+$x)
[.[]|.id,.n];INDEX(.id)|length;{n:length,s:(map(.id)|add)};[.[]|{g,id}]|group_by(.g)|map({g:.[0].g,m:(map(.id)|max)});map(.v|.>2 and .<50);map(select(.n))|map(.id);sort_by(.n)|.[0].id
any(.[];.n==7);all(.[];.id>0);map(any((.a//[])[];.>4));map([limit(2;(.a//[])[])]);map([range(.id)]|add);map({id,n:(.n//0)}|map_values(.+1));map(getpath(["n"]));map(.n|toarray);map(.s|tojson);map(.s|@json)
map((.s//"it's")|@sh);map(.s//""|indices("b"));map(.s//"abab"|rindex("b"));map(.s//""|split("b *";null));map(.s//"xaxx"|trimstr("x"));map([range(2;.id)]|length)""".replace("\n", ";").split(";")


def joined(parts: list[str]) -> list[str]:
    """Programs again, where a semicolon stood inside one."""
    out: list[str] = []
    for p in parts:
        if out and out[-1].count("(") != out[-1].count(")"):
            out[-1] += ";" + p
        else:
            out.append(p)
    return out


def test_plans_agree_with_the_evaluator(spark):
    rows = [(1, 5, 2.5, "ab", "x", [1, 2]), (2, None, -1.0, "b c", "y", [3]), (3, 7, None, None, "x", []), (4, 5, 2.5, "é", "y", [5, 1, 5]), (5, 0, 100.0, "ab", "z", None)]
    df = spark.createDataFrame(rows, "id int, n int, v double, s string, g string, a array<int>")
    data = [r.asDict() for r in df.collect()]

    def plain(x):
        return [plain(y) for y in x] if isinstance(x, list) else {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else compare.cell(x)

    for program in joined(PLANNED):
        got = [r.asDict(True) for r in api.jq(df, program, order=["id"]).collect()]
        got = [plain(r["value"] if list(r) == ["value"] else r) for r in got]
        want = evaluate(program, data)
        want = want[0] if len(want) == 1 and isinstance(want[0], list) else want
        assert sorted(map(str, got)) == sorted(str(plain(w)) for w in want), program
