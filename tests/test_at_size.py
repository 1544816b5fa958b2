"""What small tables cannot show: numbering with payload, one file of many spans, digests as json prints them, and tokens of awkward source."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from edgewright.operators import evaluation, extract, graph, intervals, resolution, tokens
from edgewright.sources import files


@pytest.mark.parametrize("parts", ["1", "7", "200"])
def test_numbers_lack_nothing_however_ranges_fall(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        n = 100_000
        rows = spark.range(n).select(F.xxhash64("id").alias("k"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("payload"), (F.col("id") % 3).alias("kind"))
        numbered = graph.with_ids(rows, "k", name="at")
        assert numbered.select(F.count("*"), F.countDistinct("at"), F.min("at"), F.max("at"), F.countDistinct("payload")).first() == (n, n, 0, n - 1, n)
        wrong = numbered.alias("a").join(numbered.alias("b"), F.col("b.at") == F.col("a.at") + 1).where(F.col("a.k") >= F.col("b.k"))
        assert wrong.count() == 0
        assert evaluation.stride_sample(rows, 1000, ["k"]).count() == 1000
        assert sorted(r["count"] for r in evaluation.stride_sample(rows, 100, ["k"], ["kind"]).groupBy("kind").count().collect()) == [100] * 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_file_of_many_spans(spark):
    n = 50_000
    spans = spark.range(n).select(F.lit("f").alias("file"), F.col("id").alias("seq"), F.concat(F.lit("s"), "id").alias("name"), (F.col("id") * 3).alias("start"), (F.col("id") * 3 + F.col("id") % 5).alias("end"))
    points = spark.range(n).select(F.lit("f").alias("file"), F.col("id").alias("point_id"), (F.col("id") * 3 + 1).alias("line"))
    got = {r["point_id"]: r["name"] for r in resolution.innermost(points, spans).collect()}
    for p in random.Random(1).sample(range(2, n), 300):
        line = 3 * p + 1
        around = [(s % 5, s) for s in (p - 1, p) if 3 * s <= line <= 3 * s + s % 5]
        assert got[p] == (f"s{min(around)[1]}" if around else None)


def test_cells_make_up_their_span(spark):
    rng = random.Random(2)
    pairs = [(0, 0), (0, 7), (5, 4), (1, 2**31 - 2)] + [(a, a + rng.randint(0, 300)) for a in (rng.randint(0, 500) for _ in range(60))]
    rows = spark.createDataFrame(pairs, "a long, b long").select("a", "b", intervals.span_cells(F.col("a"), F.col("b"), 32).alias("c")).collect()
    for r in rows:
        held = sorted((c["cell"] << c["level"], (c["cell"] + 1) << c["level"]) for c in r["c"])
        assert all(x[1] == y[0] for x, y in zip(held, held[1:])) and len(held) <= 2 * 33
        assert (held[0][0], held[-1][1] - 1) == (r["a"], r["b"]) if r["b"] >= r["a"] else not held


def test_digest_is_that_of_json(spark):
    texts = ["a", "é", "\x01\x1f\x7f", 'q"\\/', "\b\f\n\r\t", "𝒳", None, "", "ü" * 3]
    numbers = [0.5, 1e-05, 0.0001, 123456789.0, 1e16, 1e15, 1.5e300, -0.0, None, 0.1 + 0.2, -2.5e-07, 12345678901234567.0, 100.0]
    rows = [(k, texts[k % len(texts)], numbers[k % len(numbers)], k * 7, k % 2 == 0) for k in range(200)]
    got = evaluation.records_digest(spark.createDataFrame(rows, "id long, t string, x double, n int, b boolean").repartition(5), ["t", "x", "n", "b"], ["id"]).first()
    want = hashlib.sha256(json.dumps([list(r[1:]) for r in rows], separators=(",", ":")).encode()).hexdigest()
    assert tuple(got) == (200, want)


def test_evaluation_of_rings_and_of_nothing(spark):
    kind = "array<struct<kind:string,text:string>>"
    bindings = spark.createDataFrame([("f", "a", 0, [("ref", "b")]), ("f", "b", 0, [("ref", "a")]), ("f", "c", 0, [("literal", "1")]), ("f", "c", 1, [("literal", "2")])], f"file string, name string, seq int, parts {kind}")
    values = spark.createDataFrame([(1, "f", [("ref", "a")]), (2, "f", [("literal", "/"), ("ref", "c")]), (3, "g", [("ref", "c")])], f"id int, file string, parts {kind}")
    got = {r["id"]: (r["shown"], r["value"], r["verdict"]) for r in resolution.evaluate(values, bindings).collect()}
    assert got == {1: ("{unknown}", None, "cycle"), 2: ("/2", "/2", "resolved"), 3: ("{unknown}", None, "unknown")}
    assert resolution.evaluate(values.limit(0), bindings).count() == 0


def lexed(spark, path, text):
    return tokens.tokens(files.from_rows(spark, [(path, text)])).orderBy("seq").collect()


def test_tokens_of_awkward_typescript(spark):
    got = lexed(spark, "a.ts", "const r = a / b / c; const q = /[/\"]+/g.test(x)\nlet t = `a${`b${1}`}c ${ {k: '}'} }`\nf(function () { return 'x' })\n")
    assert [(r.kind, r.text) for r in got if r.kind == "regex"] == [("regex", '/[/"]+/g')]
    outer = next(r for r in got if r.kind == "template")
    assert [(p.kind, p.value, p.source) for p in outer.parts] == [("text", "a", None), ("expression", None, "`b${1}`"), ("text", "c ", None), ("expression", None, "{k: '}'}")]
    assert [r.callee for r in got if r.callee][-1] == "f"
    assert not [r for r in got if r.fault]


def test_tokens_go_on_after_what_is_torn(spark):
    got = lexed(spark, "a.py", "x = f(1,\ndef g():\n    return 2\n'''open\n")
    assert [(r.line, r.fault) for r in got if r.fault] == [(1, "never-closed")]
    assert got[-1].kind == "string" and got[-1].value == "open\n"
    assert {r.stmt for r in got if r.text in ("def", "return")} == {r.seq for r in got if r.text in ("def", "return")}


def test_long_file_is_read_in_one_pass(spark):
    text = "".join(f"def f{k}(a):\n    return requests.get('/p/{k}')\n" for k in range(20_000))
    found = tokens.tokens(files.from_rows(spark, [("long.py", text)]))
    assert extract.http_calls(found).count() == 20_000
