"""Source tables at size: lexed once by many tasks, and met without sending a side to the driver."""

import pytest
from pyspark.sql import functions as F

from edgewright.operators import extract, labelling, tokens
from edgewright.plans import labelling as labelled
from edgewright.plans import source_text, varied_source
from edgewright.sources import files


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def source(spark):
    text = F.concat(F.lit('@app.get("/x")\ndef f():\n    return go("a" + b, "'), F.col("id").cast("string"), F.lit('")\n'))
    return files.gate(files.supported(spark.range(200).coalesce(1).select(F.concat(F.lit("s"), "id", F.lit(".py")).alias("path"), text.cast("binary").alias("content"))))


def test_one_partition_of_files_is_lexed_by_many_tasks(spark, source):
    found = tokens.tokens(source)
    assert len(found.select("file", F.input_file_name().alias("part")).select("part").distinct().collect()) > 1
    assert found.select("file").distinct().count() == 200


@pytest.mark.parametrize("facts", [extract.concatenations, extract.strings, extract.calls, extract.routes, extract.http_calls, extract.symbols, lambda t: extract.with_exports(extract.symbols(t), t), lambda t: extract.routers(t)[1]])
def test_facts_neither_lex_again_nor_broadcast(spark, source, facts):
    shown = plan(facts(tokens.tokens(source)))
    assert "MapInArrow" not in shown and "Broadcast" not in shown


def test_labels_and_endpoints_do_not_broadcast(spark, source):
    lines = files.lines(source, raw=True)
    nodes = spark.createDataFrame([("a", "function", "f", "s1.py", 2), ("b", "function", "go", "s2.py", 3)], "id string, kind string, name string, file string, line int")
    edges = spark.createDataFrame([("e", "http-call", "a", "b", "s1.py", 3, ""), ("c", "call", "a", "b", "s1.py", 3, "")], "id string, kind string, source string, target string, file string, line int, evidence string")
    served = spark.createDataFrame([], "file string, line int, method string, path string, refusal string")
    labels = labelling.label_edges(edges, nodes, lines, labelling.stated_tables(lines), labelling.stated_requests(lines, edges), served)
    assert "Broadcast" not in plan(labels) and "Broadcast" not in plan(labelling.endpoint_checks(edges, nodes, lines))
    assert {r.id: r.label for r in labels.collect()} == {"e": "UNVERIFIABLE", "c": "UNVERIFIABLE"}


def test_files_of_a_small_table_of_keys_are_made_by_many_tasks(spark, tmp_path):
    spark.range(200).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    made = source_text.repository(spark, str(tmp_path))
    assert made.count() == 200 * 9
    assert len(made.select(F.spark_partition_id().alias("task")).distinct().collect()) > 1


def test_routes_and_what_they_decorate_are_told_by_the_heads_of_statements(spark):
    text = '@app.get("/a", methods=["GET"])\n@other\nasync def f(x=path("no")):\n    y = 1\nurls = [path("b/", g), views.re_path("c/", h)]\n'
    found = tokens.tokens(files.from_rows(spark, [("a.py", text)]))
    shown = plan(extract.routes(found))
    assert "holder" in shown and "head" in shown
    assert sorted((r.line, r.path_value, r.handler) for r in extract.routes(found).collect()) == [(1, "/a", "f"), (5, "b/", "g"), (5, "c/", "h")]
    got = {(r.head, r.holder) for r in found.where("text in ('[', 'y', 'h')").collect()}
    assert got == {("@", "app.get"), ("y", None), ("urls", None), ("urls", "views.re_path")}


def test_strings_read_only_imports_and_places_with_a_plus(spark):
    text = "import a from 'm'\nexport { b } from './n'\nconst c = 'p' + d + f('q' + 'r', 's')\nexport const e = ['t', 'u']\n"
    found = tokens.tokens(files.from_rows(spark, [("a.ts", text)]))
    shown = plan(extract.strings(found))
    assert "summed" in shown and "head" in shown
    assert sorted(r.value for r in extract.strings(found).collect()) == ["t", "u"]
    assert {r.text for r in found.where("summed and kind = 'name'").collect()} == {"const", "c", "d", "f"}


@pytest.mark.parametrize("made", [varied_source.varied_tokens, source_text.more_tokens])
def test_tokens_of_suppliers_start_from_dealt_keys(spark, tmp_path, monkeypatch, made):
    spark.range(50).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    seen = []
    monkeypatch.setattr(tokens, "tokens", lambda read: seen.append(read))
    made(spark, str(tmp_path))
    assert seen[0].rdd.getNumPartitions() == 4


def test_routers_and_calls_read_only_the_brackets_of_calls(spark):
    text = 'r = fastapi.APIRouter(prefix="/a")\nmain.include_router(r, prefix="/b")\ndef f(a, b=go([1, 2], {3: 4})):\n    return x[stop(), 1]\n'
    found = tokens.tokens(files.from_rows(spark, [("a.py", text)]))
    declared, included = extract.routers(found)
    called = extract.calls(found)
    assert all("holder" in plan(x) for x in (declared, included, called))
    assert [(r.name, r.prefix) for r in declared.collect()] == [("r", "/a")]
    assert [(r.parent, r.child, r.prefix) for r in included.collect()] == [("main", "r", "/b")]
    assert sorted((r.callee, r.argument_count) for r in called.collect()) == [("fastapi.APIRouter", 1), ("main.include_router", 2), ("stop", 0)]


def test_stated_rows_of_suppliers_start_from_dealt_keys(spark, tmp_path):
    spark.range(50).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    rows = labelled.stated(spark, str(tmp_path), "id string, line int", [("a@@", 1), ("b@@", 2)])
    assert rows.rdd.getNumPartitions() == 4 and rows.count() == 100
