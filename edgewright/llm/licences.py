"""License scans: phrases at word positions, and an exact set-similarity join of text blocks with license templates.

DataFrame functions only. A block matches a template when it holds CONTAINED of the template's distinct words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewright.llm.shared import written

#: Base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Templates in words, with the labels they give.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-2"),
)
CONTAINED = 0.9
#: Blocks start every STRIDE words and hold twice as many, so a run of up to STRIDE words lies whole in one.
STRIDE = 24
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" ")))


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    Null and empty texts have no words, no labels and score 0. ``score`` is the largest share of a matched template's words
    in a block, or 1 where a base phrase stands. Texts of any length are read whole, in blocks. Repeated rows have equal results; of templates that share
    as much all labels are given. An empty table gives an empty one; other columns are left out, whatever their names.
    """
    spark = docs.sparkSession
    vocabulary = sorted({w for t, _ in TEMPLATES for w in t.split()})
    words = F.trim(F.regexp_replace(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), GAP, " "))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(F.lit(1), text, doc_id).alias("k2"), words.alias("line"))
    rows = rows.withColumn("n_words", F.when(F.col("line") == "", 0).otherwise(_spaces(F.col("line")) + 1).cast("long"))
    rows = rows.withColumn("list", F.split("line", " ", -1)).withColumn("line", F.concat(F.lit(" "), "line", F.lit(" ")))
    for k, phrase in enumerate(PHRASES):
        parts = F.when(F.contains("line", F.lit(f" {phrase} ")), F.split("line", f"(?<= ){phrase}(?= )", -1))
        rows = rows.withColumn(f"parts{k}", parts)
    n, first, last = [], [], []
    for k, phrase in enumerate(PHRASES):
        part, size = F.col(f"parts{k}"), phrase.count(" ") + 1
        n.append(F.when(part.isNull(), 0).otherwise(F.size(part) - 1))
        first.append(_spaces(F.element_at(part, 1)) - 1)
        last.append(F.col("n_words") - (_spaces(F.element_at(part, -1)) - 1) - size)
    known = F.array(*(F.when(F.col(f"parts{k}").isNotNull(), F.lit(label)) for k, label in enumerate(PHRASES.values())))
    hits = F.when(
        F.col("n_words") > 0,
        F.filter(F.sequence(F.lit(0), F.col("n_words").cast("int") - 1), lambda i: F.element_at("list", i + 1).isin(vocabulary)),
    )
    rows = rows.select(
        "doc_id",
        "k1",
        "k2",
        "n_words",
        sum(n[1:], n[0]).cast("long").alias("n_base"),
        F.least(*first).cast("long").alias("first_word"),
        F.greatest(*last).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(known))).alias("base"),
        F.transform(hits, lambda i: F.struct(i.alias("pos"), F.element_at("list", i + 1).alias("word"))).alias("hits"),
    )
    rows, _ = written(rows, "license-words")

    # Documents that hold each template word, over all documents; a row for each word of the templates.
    holders = rows.select(F.explode(F.array_distinct("hits.word")).alias("word")).groupBy("word").agg(F.count("*").alias("docs")).collect()
    often = {r.word: r.docs for r in holders}
    order = sorted(vocabulary, key=lambda w: (often.get(w, 0), w))
    rank = {w: i + 1 for i, w in enumerate(order)}
    templates, prefixes = [], []
    for t, (template, label) in enumerate(TEMPLATES):
        own = sorted(rank[w] for w in set(template.split()))
        need = math.ceil(CONTAINED * len(own))
        templates.append((t, label, own, len(own), need))
        prefixes += [(r, t, place) for place, r in enumerate(own[: len(own) - need + 1])]
    templates = spark.createDataFrame(templates, "template int, label string, own array<int>, size int, need int")
    prefixes = spark.createDataFrame(prefixes, "rank int, template int, at int").join(templates, "template")
    least = min(math.ceil(CONTAINED * len(set(t.split()))) for t, _ in TEMPLATES)
    rare = [order[r - 1] for r in sorted({r.rank for r in prefixes.select("rank").collect()})]

    near = rows.where(F.exists("hits", lambda h: h["word"].isin(rare))).select("k1", "k2", F.explode("hits").alias("hit")).distinct()
    block = F.expr(f"explode(filter(array(hit.pos div {STRIDE}, hit.pos div {STRIDE} - 1), b -> b >= 0))")
    place = F.array_position(F.array(*map(F.lit, order)), F.col("hit.word")).cast("int")
    blocks = near.select("k1", "k2", place.alias("rank"), block.alias("block")).groupBy("k1", "k2", "block")
    blocks = blocks.agg(F.array_sort(F.collect_set("rank")).alias("ranks")).where(F.size("ranks") >= least)
    indexed = blocks.select("k1", "k2", "block", "ranks", F.posexplode("ranks").alias("place", "rank")).where(F.col("place") <= F.size("ranks") - least)
    left = F.least(F.size("ranks") - F.col("place"), F.col("size") - F.col("at"))
    pairs = indexed.join(prefixes, "rank").where((F.size("ranks") >= F.col("need")) & (left >= F.col("need")))
    pairs = pairs.dropDuplicates(["k1", "k2", "block", "template"]).withColumn("shared", F.size(F.array_intersect("ranks", "own")))
    found = pairs.where(F.col("shared") >= F.col("need")).groupBy("k1", "k2")
    found = found.agg(F.collect_set("label").alias("more"), F.max(F.col("shared") / F.col("size")).alias("share"))
    joined = rows.drop("hits").join(found, ["k1", "k2"], "left")
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def oracle() -> str:
    """The same rows in SQL: every block against every template."""
    values = ", ".join(f"('{label}', {sorted(set(t.split()))}, {math.ceil(CONTAINED * len(set(t.split())))})" for t, label in TEMPLATES)
    places = []
    for phrase in PHRASES:
        parts = phrase.split()
        test = " and ".join(f"w[i + {k + 1}] = '{p}'" for k, p in enumerate(parts))
        places.append(f"list_filter(range(0, len(w)), lambda i: {test})")
    labels = ", ".join(f"case when len({p}) > 0 then '{label}' end" for p, label in zip(places, PHRASES.values(), strict=True))
    return f"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from documents
), base as (
  select doc_id, len(w) as n_words, list_sort({" || ".join(places)}) as places,
         list_sort(list_distinct(list_filter([{labels}], lambda x: x is not null))) as base
  from words
), blocks as (
  select doc_id, list_distinct(list_slice(w, {STRIDE} * b + 1, {STRIDE} * b + {2 * STRIDE})) as held
  from (select doc_id, w, unnest(range(0, (len(w) + {STRIDE - 1}) // {STRIDE})) as b from words)
), templates(label, own, need) as (values {values}),
found as (
  select doc_id, list(distinct label) as more, max(shared / len(own)) as share
  from (select doc_id, label, own, need, len(list_intersect(held, own)) as shared from blocks, templates)
  where shared >= need group by doc_id
)
select b.doc_id, cast(n_words as bigint) as n_words, cast(len(places) as bigint) as n_base,
       cast(places[1] as bigint) as first_word, cast(places[-1] as bigint) as last_word,
       array_to_string(base, ',') as base_labels,
       array_to_string(list_sort(list_distinct(base || coalesce(more, []))), ',') as labels,
       case when len(places) > 0 then 1.0::double else coalesce(share, 0.0)::double end as score
from base b left join found f on b.doc_id = f.doc_id
"""
