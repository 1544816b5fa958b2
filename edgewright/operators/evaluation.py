"""Scoring of labelled edges: intervals, calibration, thresholds, samples and splits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgewright.operators.graph import with_ids

TP, FP, UNVERIFIABLE = "TRUE_POSITIVE", "FALSE_POSITIVE", "UNVERIFIABLE"
#: Verified records from which a group's figures are called adequate.
WEAK_SAMPLE = 30
THRESHOLDS = (0.0, 0.6, 0.65, 0.7, 0.75, 0.784, 0.8, 0.85, 0.9, 0.95, 0.98, 0.99)


def _count(test: Column) -> Column:
    return F.count(F.when(test, 1))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a / b)


def precision_recall(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 of rows with an ``outcome`` of tp, fp or fn; null where a denominator, or P or R, is 0."""
    tp, fp, fn = (_count(F.col("outcome") == o) for o in ("tp", "fp", "fn"))
    rows = scored.groupBy(*keys).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    rows = rows.withColumns({"precision": p, "recall": r})
    good = (F.col("precision") > 0) & (F.col("recall") > 0)
    return rows.withColumn("f1", F.when(good, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def wilson(successes: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Low and high end of the Wilson score interval within 0 and 1; null for no trials."""
    share = successes / total
    scale = 1 + z * z / total
    centre = (share + z * z / (2 * total)) / scale
    margin = z * F.sqrt(share * (1 - share) / total + z * z / (4 * total * total)) / scale
    some = total > 0
    return F.when(some, F.greatest(F.lit(0.0), centre - margin)), F.when(some, F.least(F.lit(1.0), centre + margin))


def _summary() -> list[Column]:
    label = F.col("label")
    return [F.count("label").alias("produced"), _count(label == TP).alias("true_positive"), _count(label == FP).alias("false_positive"), _count(label == UNVERIFIABLE).alias("unverifiable")]


def _figures(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("verified", F.col("true_positive") + F.col("false_positive"))
    low, high = wilson(F.col("true_positive"), F.col("verified"))
    return rows.withColumns(
        {
            "unverifiable_share": F.round(ratio(F.col("unverifiable"), F.col("produced")), 4),
            "observed_accuracy": F.round(ratio(F.col("true_positive"), F.col("verified")), 4),
            "ci_low": F.round(low, 4),
            "ci_high": F.round(high, 4),
            "sample_adequate": F.col("verified") >= WEAK_SAMPLE,
        }
    )


def group_summary(records: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by label, observed accuracy and its interval for each group."""
    return _figures(records.groupBy(*keys).agg(*_summary()))


def reliability_bins(records: DataFrame, bins: int = 10) -> DataFrame:
    """group_summary by equal widths of confidence, in double division; every bin has a row."""
    width = 1.0 / bins
    index = F.least(F.floor(F.col("confidence").cast("double") / F.lit(width)), F.lit(bins - 1)).cast("int")
    mean = F.round(F.avg(F.col("confidence").cast("double")), 4).alias("mean_confidence")
    found = records.withColumn("bin", index).groupBy("bin").agg(*_summary(), mean)
    every = records.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    filled = every.join(found, "bin", "left").na.fill(0, ["produced", "true_positive", "false_positive", "unverifiable"])
    return _figures(filled)


def calibration_error(records: DataFrame) -> DataFrame:
    """Expected and maximum calibration error over verified records, by distinct confidence, in one row."""
    kept = records.where(F.col("label").isin(TP, FP))
    conf = F.col("confidence").cast("double")
    groups = kept.groupBy(conf.alias("confidence")).agg(F.count("*").alias("n"), F.avg((F.col("label") == TP).cast("double")).alias("accuracy"))
    gap = F.abs(F.col("accuracy") - F.col("confidence"))
    return groups.agg(
        F.round(F.sum(F.col("n") * gap) / F.sum("n"), 4).alias("ece"), F.round(F.max(gap), 4).alias("mce"), F.coalesce(F.sum("n"), F.lit(0)).alias("verified")
    )


def threshold_curve(records: DataFrame, steps: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """What is kept, and how precise it is, as the accepted confidence rises.

    One pass: a record counts towards every step that it reaches, as an aggregate column each.
    """
    conf, tp, fp = F.col("confidence").cast("double"), F.col("label") == TP, F.col("label") == FP
    columns = [_count(tp).alias("all_tp"), _count(tp | fp).alias("verified")]
    for i, t in enumerate(steps):
        columns += [_count(tp & (conf >= t)).alias(f"tp{i}"), _count(fp & (conf >= t)).alias(f"fp{i}")]
    one = records.agg(*columns)
    rows = F.explode(F.array(*(F.struct(F.lit(t).cast("double").alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp")) for i, t in enumerate(steps))))
    out = one.select("all_tp", "verified", rows.alias("s")).select("all_tp", "verified", "s.*")
    kept = F.col("tp") + F.col("fp")
    return out.select(
        "threshold",
        kept.alias("kept"),
        F.round(ratio(kept, F.col("verified")), 4).alias("coverage_of_verified"),
        F.round(ratio(F.col("tp"), kept), 4).alias("precision"),
        F.round(ratio(F.col("tp"), F.col("all_tp")), 4).alias("retained_true_positives"),
        F.col("fp").alias("false_positives_admitted"),
    )


def holdout(*key: Column, parts: int = 4) -> Column:
    """Whether a key falls into the held-out part: the first 32 bits of its SHA-256 leave no remainder."""
    digest = F.sha2(F.concat_ws("|", *key), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % parts == 0


def stride_sample(rows: DataFrame, target: int, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """``target`` rows of each key evenly spaced in order: those at int(j * (n / target)) for each j, in floating point as labellers count.

    Rows are numbered over range partitions and from their key's first number, so no key meets in one task. Ties of keys and order must not occur.
    """
    keys = keys or []
    numbered = with_ids(rows, *keys, *order, name="__at")
    if keys:
        own = numbered.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
        ranked = numbered.join(own, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    else:
        ranked = numbered.withColumns({"__first": F.lit(0), "__n": F.lit(rows.count())})
    ranked = ranked.select(*rows.columns, (F.col("__at") - F.col("__first")).alias("__i"), "__n")
    stride = F.col("__n") / F.lit(float(target))
    near = F.floor(F.col("__i") / stride)
    hit = lambda d: (near + d).between(0, target - 1) & (F.floor((near + d) * stride) == F.col("__i"))
    taken = (F.col("__n") <= target) | hit(-1) | hit(0) | hit(1)
    return ranked.where(taken).drop("__i", "__n")


def set_difference(declared: DataFrame, scored: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, told by ``side``; repeats count once."""
    left = declared.subtract(scored).withColumn("side", F.lit("declared-only"))
    return left.unionByName(scored.select(*declared.columns).subtract(declared).withColumn("side", F.lit("scored-only")))


def records_digest(records: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Number of records and SHA-256 of the JSON list of their ``columns``, compact, in the given order, as Python's json module prints it.

    The digest of one text is sequential: records are sorted by range on the cluster and their texts streamed through one task, which holds a batch at a time.
    Columns are text, numbers or booleans.
    """
    row = F.concat(F.lit("["), F.concat_ws(",", *(json_text(F.col(c), records.schema[c].dataType) for c in columns)), F.lit("]"))
    listed = records.select(*order, row.alias("__row")).orderBy(*order).select("__row")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, n = hashlib.sha256(b"["), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                sha.update((b"," if n else b"") + text.encode())
                n += 1
        sha.update(b"]")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([sha.hexdigest()])], names=["records", "digest"])

    return listed.coalesce(1).mapInArrow(digest, "records long, digest string")


def json_text(value: Column, kind: T.DataType) -> Column:
    """A value as Python's json module prints it: null, true, a number, or text in quotes with everything beyond ASCII as \\uXXXX."""
    if isinstance(kind, T.StringType):
        unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

        def shown(c: Column) -> Column:
            n = F.ascii(c)
            short = F.element_at(F.create_map(*(F.lit(x) for pair in {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r", 34: '\\"', 92: "\\\\"}.items() for x in pair)), n)
            pair = F.concat(unit(F.lit(0xD800) + F.call_function("shiftright", n - 0x10000, F.lit(10))), unit(F.lit(0xDC00) + n.bitwiseAND(0x3FF)))
            return F.when(short.isNotNull(), short).when((n < 32) | (n.between(127, 0xFFFF)), unit(n)).when(n > 0xFFFF, pair).otherwise(c)

        plain = value.rlike(r'^[ !#-\[\]-~]*$')
        text = F.when(plain, value).otherwise(F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), shown), ""))
        return F.when(value.isNull(), "null").otherwise(F.concat(F.lit('"'), text, F.lit('"')))
    if not isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.coalesce(value.cast("string"), F.lit("null"))
    number = value.cast("double")
    text = F.abs(number).cast("string")
    part = lambda k: F.regexp_extract(text, r"^(\d+)\.(\d+)(?:E(-?\d+))?$", k)
    all_ = F.concat(part(1), part(2))
    lead = F.length(all_) - F.length(F.ltrim(all_, F.lit("0")))
    digits, zero = F.regexp_replace(F.ltrim(all_, F.lit("0")), "0+$", ""), number == 0
    e = F.length(part(1)) - 1 + F.when(part(3) != "", part(3).cast("int")).otherwise(0) - lead
    tail = lambda d, k: F.when(F.length(d) > k, F.substring(d, k + 1, F.length(d))).otherwise("0")
    whole = F.concat(F.rpad(F.substring(digits, F.lit(1), e + 1), e + 1, F.lit("0")), F.lit("."), tail(digits, e + 1))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
    power = F.concat(F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), F.lit("0")))
    science = F.concat(F.substring(digits, 1, 1), F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), F.length(digits)))).otherwise(""), F.lit("e"), power)
    shown = F.when(zero, "0.0").when((e >= 0) & (e < 16), whole).when((e < 0) & (e >= -4), small).otherwise(science)
    sign = F.when((number < 0) | ((number == 0) & F.startswith(number.cast("string"), F.lit("-"))), "-").otherwise("")
    return F.when(number.isNull(), "null").when(F.isnan(number), "NaN").when(F.abs(number) == float("inf"), F.concat(sign, F.lit("Infinity"))).otherwise(F.concat(sign, shown))
