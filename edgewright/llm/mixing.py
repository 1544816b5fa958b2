"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewright.llm.shared import written

WORD = r"[^\x20\x09-\x0D]+"
#: Expected copies lean towards long documents by this share of the room that the source's mean leaves.
TILT = 0.5
#: A document of so many words lies in the middle of that leaning.
MIDDLE = 200
#: Pareto keys are summed in so many steps to find where a source's residual is reached.
STEPS = 2048
#: Single documents that may be added to or left of a source's cut to land on its target.
LAST_PLACES = 4


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Add ``target`` to rows (source, source_size): shares by weight, at most ``most`` times the size, the excess reshared by weight.

    Sources in code point order, null last, take the weights in turn. Filling by rising ratio of cap to
    weight gives the end of all resharing at once: a source is capped when its ratio is at most the level left to it.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double")
    rows = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    first = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(every)["level"]
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("cap"), first * F.col("weight")))
    return rows.withColumn("target", target).select("source", "source_size", "target")


def _lean(size: Column) -> Column:
    return size / (size + MIDDLE)


def _plan(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Certain copies, inclusion probability of one more, and Pareto key of each row."""
    mean = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    room = TILT * F.least(mean, F.lit(2.0) - mean)
    expected = F.round(mean + room * (_lean(F.col("size")) - F.col("lean")), 9)
    odds = lambda x: x / (1 - x)
    joined = rows.join(params.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    planned = joined.withColumn("expected", expected).withColumn("certain", F.floor("expected")).withColumn("more", F.col("expected") - F.col("certain"))
    ratio = odds(F.col("u")) / odds(F.col("more"))
    return planned.withColumn("key", F.when(F.col("more") > 0, ratio / (1 + ratio)))


def pareto_mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 20,
    source: str = "source",
    text: str = "text",
    doc_id: str = "doc_id",
) -> tuple[DataFrame, DataFrame]:
    """(rows, choices): rows (doc_id, source, size, hash) and, for each source, what decides a row's copies; see ``copies``.

    A document's size is its number of words. Its expected copies are its source's target over its size, leaning
    towards long documents and never above ``most`` (2 at most); the whole part is certain, the rest is the
    probability of one more copy. Rows are ranked by random odds over inclusion odds and taken in that order until the
    source's residual words are reached; up to LAST_PLACES more go to those untaken documents that land nearest the residual.
    Randomness is a hash of seed, doc_id and text, so reruns agree and equal rows share one decision, by the size of all of them. Null and empty texts
    have size 0; a null source is a source of its own; a source without words has target 0. Texts of any length are read only for their size; an empty
    table gives an empty one; other columns are left out, whatever their names. Only per-source sums and one step of keys of each source meet in a task.
    """
    if not 0 < most <= 2 or share > most:
        raise ValueError("a document can be taken twice at most")
    key = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text))
    size = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), key.alias("hash"))
    rows, _ = written(rows, "sizes")
    rows = rows.withColumn("u", (F.pmod("hash", F.lit(1 << 52)) + 0.5) / float(1 << 52))
    words = F.sum("size").alias("source_size")
    sums = rows.groupBy("source").agg(words, F.sum(F.col("size") * _lean(F.col("size"))).alias("leaning"))
    lean = F.when(F.col("source_size") > 0, F.col("leaning") / F.col("source_size")).otherwise(0.0)
    params = targets(sums.select("source", "source_size"), weights, share, most).join(
        sums.select(F.col("source").alias("source_"), lean.alias("lean")), F.col("source").eqNullSafe(F.col("source_"))
    )
    params, _ = written(params.drop("source_"), "targets")

    planned = _plan(rows, params)
    sure = planned.groupBy("source").agg(F.sum(F.col("certain") * F.col("size")).alias("sure"))
    chance = planned.where(F.col("key").isNotNull()).withColumn("step", F.least(F.floor(F.col("key") * STEPS), F.lit(STEPS - 1)))
    steps = chance.groupBy("source", "step").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("before", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    left = params.join(sure.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_")))
    left = left.select(F.col("source").alias("source_"), (F.round("target") - F.col("sure")).cast("long").alias("residual"))
    here = steps.join(left, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    here = here.where((F.col("before") <= F.col("residual")) & (F.col("before") + F.col("words") > F.col("residual")))
    here = here.select(F.col("source").alias("source_"), F.col("step").alias("step_"), "before", "residual")
    # Within the step where the residual is reached: the last key that still fits.
    inside = chance.join(here, F.col("source").eqNullSafe(F.col("source_")) & (F.col("step") == F.col("step_")))
    running = Window.partitionBy("source").orderBy(F.struct("key", "hash"))
    inside = inside.withColumn("upto", F.col("before") + F.sum("size").over(running))
    fits = F.when(F.col("upto") <= F.col("residual"), F.struct("key", "hash", "upto"))
    cut = inside.groupBy("source").agg(F.max(fits).alias("cut"), F.first("step").alias("cut_step"), F.first("before").alias("before"), F.first("residual").alias("residual"))
    cut = cut.select(
        F.col("source").alias("source_"),
        F.coalesce("cut.key", F.col("cut_step") / STEPS).alias("cut_key"),
        F.coalesce("cut.hash", F.lit(-(1 << 63))).alias("cut_hash"),
        (F.col("residual") - F.coalesce("cut.upto", "before")).alias("gap"),
    )
    # The last places: a document behind the cut that leaves the smallest difference, if that is less than without it.
    choices = params.join(cut, F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_")
    choices, _ = written(choices.withColumn("last", F.array().cast("array<bigint>")), "choices")
    for _ in range(LAST_PLACES):
        gaps = choices.where(F.abs("gap") > 0).select(F.col("source").alias("source_"), "cut_key", "cut_hash", "gap", "last")
        behind = chance.join(gaps, F.col("source").eqNullSafe(F.col("source_"))).where(~_taken())
        best = F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "key", "hash", "size")).alias("best")
        best = behind.groupBy("source").agg(best, F.first("gap").alias("was")).where(F.col("best.off") < F.abs("was"))
        # Equal rows share one decision: all of them must land nearer together.
        best, _ = written(best.select(F.col("source").alias("source_"), F.col("best.hash").alias("one"), "was"), "nearest")
        alike = chance.join(best, (F.col("hash") == F.col("one")) & F.col("source").eqNullSafe(F.col("source_")))
        alike = alike.groupBy("source_", "one", "was").agg(F.sum("size").alias("taken")).where(F.abs(F.col("taken") - F.col("was")) < F.abs("was"))
        best, _ = written(alike.select("source_", "one", "taken"), "last-places")
        if best.isEmpty():
            break
        more = choices.join(best, F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_")
        more = more.withColumn("gap", F.col("gap") - F.coalesce("taken", F.lit(0)))
        more = more.withColumn("last", F.when(F.col("one").isNull(), F.col("last")).otherwise(F.array_append("last", F.col("one"))))
        choices, _ = written(more.drop("one", "taken"), "choices")
    return rows, choices


def _taken() -> Column:
    first = (F.col("key") < F.col("cut_key")) | ((F.col("key") == F.col("cut_key")) & (F.col("hash") <= F.col("cut_hash")))
    return first | F.array_contains("last", F.col("hash"))


def copies(rows: DataFrame, choices: DataFrame) -> DataFrame:
    """Add ``copies``, ``source_size`` and ``target`` to rows that hold source, size, u and hash.

    ``choices`` has a row for each source; Spark broadcasts it while it is small and else splits skewed sources.
    A source without a cut takes every row that has a chance: its residual is above all of them.
    """
    planned = _plan(rows, choices)
    more = F.col("key").isNotNull() & (F.col("cut_key").isNull() | _taken())
    return planned.withColumn("copies", F.col("certain") + more.cast("long"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """Every document as often as the mix takes it, with the columns of ``docs``; repeats are rows of their own."""
    _, choices = pareto_mix(docs, **options)
    seed, text, doc_id = options.get("seed", 20), options.get("text", "text"), options.get("doc_id", "doc_id")
    key = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text))
    size = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")
    held = docs.select(F.struct(*docs.columns).alias("doc"), F.col(options.get("source", "source")).alias("source"), size.alias("size"), key.alias("hash"))
    held = held.withColumn("u", (F.pmod("hash", F.lit(1 << 52)) + 0.5) / float(1 << 52))
    repeated = copies(held, choices).select("doc", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return repeated.select("doc.*")
