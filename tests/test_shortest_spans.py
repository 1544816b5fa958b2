"""Points take the shortest span of their line, and a line meets a row a level, however many spans hold it."""

import random

from pyspark.sql import functions as F

from edgewright.operators import intervals, resolution

POINTS, SPANS = "file string, point_id int, line int, note string", "file string, seq int, name string, start int, end int"


def shortest(points, spans):
    """What a search of all spans gives: a point of several rows takes the least span of all its lines."""
    found = {}
    for file, point, line, _ in points:
        if None not in (file, point, line):
            around = [(e - s, (q is not None, q or 0), (n is not None, n or ""), n) for f, q, n, s, e in spans if f == file and None not in (s, e) and s <= line <= e]
            found[file, point] = min([*found.get((file, point), []), *around], default=None)
            found[file, point] = [found[file, point]] if found[file, point] else []
    return sorted(((*p, (found.get((p[0], p[1])) or [(None,)])[0][-1]) for p in points), key=str)


def test_the_shortest_span_as_a_search_of_all_finds_it(spark):
    rng = random.Random(3)
    files = ["a", "b", "c", None]
    spans = [(rng.choice(files), rng.choice([*range(40), None]), rng.choice(["x", "y", None]), s, s + rng.randint(-2, 60)) for s in (rng.randint(0, 200) for _ in range(150))]
    spans += [("a", 1, "t", None, 9), ("a", 1, "t", 3, None), *spans[:20]]
    points = [(rng.choice([*files, "none"]), rng.choice([*range(60), None]), rng.choice([*range(0, 280, 3), None]), rng.choice(["p", None])) for _ in range(300)]
    points += points[:30]  # rows that come twice; ids come on several lines
    got = resolution.innermost(spark.createDataFrame(points, POINTS), spark.createDataFrame(spans, SPANS))
    assert sorted((tuple(r) for r in got.select("file", "point_id", "line", "note", "name").collect()), key=str) == shortest(points, spans)


def test_spans_around_one_line_are_no_pairs(spark, monkeypatch):
    n, met = 400, []
    spans = spark.range(n).select(F.lit("f").alias("file"), F.col("id").alias("seq"), F.concat(F.lit("s"), "id").alias("name"), F.lit(0).alias("start"), (F.col("id") + 1000).alias("end"))
    points = spark.range(n).select(F.lit("f").alias("file"), F.col("id").alias("point_id"), (F.col("id") % 50).alias("line"))
    monkeypatch.setattr(resolution, "stabbed", lambda *a, **k: met.append(intervals.stabbed(*a, **k)) or met[-1])
    got = resolution.innermost(points, spans).collect()
    assert len(got) == n and {r["name"] for r in got} == {"s0"}
    assert met[0].count() <= 50 * 12  # lines by levels; pairs are 160,000
