"""Clients and routes meet by all segments that both state, so steps make no more rows than there are pairs."""

import random

import pytest
from pyspark.sql import functions as F

from edgewright.operators import canonical, matching

PARTS = "array<struct<kind:string,value:string,source:string>>"


def clients(spark, paths):
    """Client calls of paths; ${} stands for an expression."""
    rows = []
    for k, path in enumerate(paths):
        texts = path.split("${}")
        parts = [x for t in texts for x in (("expression", None, "x"), ("text", t, None))][1:] if len(texts) > 1 else None
        rows.append((k, "GET", "literal" if parts is None else "template", path if parts is None else None, [p for p in parts if p[1] != ""] if parts else None))
    return canonical.canonical_clients(spark.createDataFrame(rows, f"client_id long, method string, url_kind string, url_value string, url_parts {PARTS}"))


def routes(spark, paths):
    rows = [(k, "decorator", ["GET"], "literal", path, None, f"h{k}", "api.py", k) for k, path in enumerate(paths)]
    return canonical.canonical_routes(spark.createDataFrame(rows, f"route_id long, style string, methods array<string>, path_kind string, path_value string, path_parts {PARTS}, handler string, file string, line int"))


def most_rows(plan):
    """The rows that the largest node of an executed plan made."""
    kids = plan.children()
    own = plan.metrics().get("numOutputRows")
    return max([own.get().value() if own.isDefined() else 0, *(most_rows(kids.apply(k)) for k in range(kids.size()))])


@pytest.fixture
def as_planned(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("called, served", [("/v1/s@/items/${}", "/v1/s@/items/{id}"), ("/v1/${}/s@", "/v1/{x}/s@"), ("/bulk/@", "/bulk/@"), ("/v1/s@/a/b", "/v1/s@/{rest:path}")])
def test_paths_that_begin_alike_do_not_all_meet(spark, as_planned, called, served):
    n = 200
    fill = lambda path: [path.replace("@", str(k)) for k in range(n)]
    found = matching.candidates(clients(spark, fill(called)), routes(spark, fill(served)).hint("merge"))
    assert sorted((r["client_id"], r["route_id"]) for r in found.collect()) == [(k, k) for k in range(n)]
    assert most_rows(found._jdf.queryExecution().executedPlan()) <= 8 * n


def fits(client, route):
    c, r = ([s for s in path.split("/") if s] for path in (client, route))
    if r and r[-1] == "*":
        c, r = (c[: len(r) - 1], r[:-1]) if len(c) >= len(r) else ([], ["no"])
    return len(c) == len(r) and all(a == b or a == "${}" or b == "{p}" for a, b in zip(c, r, strict=True))


def test_pairs_are_those_of_comparing_all_with_all(spark):
    rng = random.Random(4)
    path = lambda k, words: "/" + "/".join(rng.choice(words) for _ in range(k))
    lengths = [0, 1, 2, 3, 4, 12]
    calls = ["/a" + path(k, ["a", "b", "=", "*", "${}"]).rstrip("/") for k in lengths for _ in range(12)] + ["/", "/a/"]
    declared = [path(k, ["a", "b", "=", "{p}"]) for k in range(6) for _ in range(8)] + ["/a" + path(k, ["a", "b", "{p}"]) + "/*" for k in (1, 2, 11) for _ in range(8)] + ["/*", "/"]
    declared += [c.replace("${}", "b").replace("*", "{p}") for c in calls if c.count("/") > 9]
    rows = matching.candidates(clients(spark, calls), routes(spark, declared)).collect()
    got = {(r["client_id"], r["route_id"]) for r in rows}
    want = {(i, j) for i, c in enumerate(calls) for j, r in enumerate(declared) if fits(c, r)}
    assert got == want and len(rows) == len(got)
    assert any(calls[i].count("/") > 9 for i, _ in got) and any(declared[j].endswith("*") for _, j in got)
