"""N-gram Jaccard join by T-occurrence search, and the connected components of its links.

Documents are sets of hashed word shingles. Two sets link when p / q of their union is shared. Work goes by
classes of documents with equal sets (key ``fp``), so copies cost a row each and are never paired.

1. Each class emits the smallest hashes of its set. Shingles that many classes emit have *long lists*, the
   rest *short lists*. The global order of shingles is short before long, each by hash. A class whose
   emitted part holds too few short ones emits its whole set, and lists are counted anew, until none is left.
2. As in DivideSkip each set's longest lists are set aside: those past its head, the first shingles in the global
   order. Two linking sets share a shingle among the first n - ceil(p n / q) + 1 of either; the inverted lists
   of these, with the length and the position filter, give candidates.
3. Merge: a candidate's occurrences in the lists of the heads are counted. It stays if they reach the required overlap
   less the lists set aside, which could each add one.
4. Probe: for what stays, the sets are binary-probed for the whole overlap.
5. Large-star and small-star rounds give components.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewright.llm import kernels as K
from edgewright.llm.shared import discard, written

#: A shingle emitted by so many classes has a long list.
LONG_LIST = 64
#: Up to so many wanted classes (32 bytes each) go to every task; Spark joins more by its own means.
MOST_BROADCAST = 1 << 19


def prefix_length(n: int, p: int, q: int) -> int:
    return n - -(-p * n // q) + 1


def least_overlap(a: int, b: int, p: int, q: int) -> int:
    """Shared shingles from which sets of a and b shingles link."""
    return -(-p * (a + b) // (p + q))


def shingle_sets(column: pa.Array, words: int, key: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each chunk: its first row, all sets end to end (each sorted), and their offsets.

    A-Z are lower-cased; words are runs of non-white bytes; a text of fewer words is one shingle, an empty one has none.
    Hashes of different tables can be compared if ``key`` is the same.
    """
    for a, b, buf, offs in K.chunks(column):
        buf = K.LOWER[buf]
        starts, ends, first = K.words(buf, offs)
        hashes = K.Spans(buf, key).hash(starts, ends)
        grams, begins = K.shingles(hashes, first, words)
        counts = np.diff(first)
        sets = []
        for i, (x, y) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)):
            if y > x:
                sets.append(np.unique(grams[x:y]))
            elif counts[i]:
                sets.append(K.shingles(hashes[first[i] : first[i + 1]], np.array([0, counts[i]]), int(counts[i]))[0])
            else:
                sets.append(grams[:0])
        yield a, np.concatenate(sets or [grams[:0]]), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def _fingerprint(sets: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix(sets + np.uint64(0x51ED270B)), dtype=np.uint64)])
    return K.mix(total[offs[1:]] - total[offs[:-1]] + np.diff(offs).astype(np.uint64)).view(np.int64)


def _extra(k):
    """Shingles that are held beyond a prefix of k."""
    return np.maximum(4, k // 4)


def _emit(batches: Iterator[pa.RecordBatch], words: int, p: int, q: int, key: bytes) -> Iterator[pa.RecordBatch]:
    """A row for each document: size and key of its set, and the smallest hashes of it."""
    for batch in batches:
        for a, sets, offs in shingle_sets(batch.column(1), words, key):
            n = np.diff(offs)
            k = prefix_length(n, p, q)
            part = np.minimum(n, k + _extra(k)) * (n >= fewest(p, q))
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(part)]).astype(np.int32)), pa.array(K.ragged(sets, offs[:-1], part).view(np.int64))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, len(n)), pa.array(n), pa.array(_fingerprint(sets, offs)), batch.column(2).slice(a, len(n)), lists],
                names=["doc_id", "n", "fp", "text_key", "tokens"],
            )


def fewest(p: int, q: int) -> int:
    """Size of the smallest set that can link to a different one."""
    return math.ceil(p / (q - p))


def _whole(batches: Iterator[pa.RecordBatch], words: int, key: bytes) -> Iterator[pa.RecordBatch]:
    """(fp, every) of rows (fp, text): the whole set."""
    for batch in batches:
        for a, sets, offs in shingle_sets(batch.column(1), words, key):
            lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(sets.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(offs) - 1), lists], names=["fp", "every"])


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, text) of the classes ``wanted`` (fp, one: the row that stands for the class)."""
    few = wanted.count() <= MOST_BROADCAST
    own = wanted.select("fp", F.col("one.doc_id").alias("one_doc"), F.col("one.text_key").alias("one_key"))
    own = F.broadcast(own) if few else own
    met = docs.join(own, F.col("doc_id").eqNullSafe(F.col("one_doc")) & (F.col("text_key") == F.col("one_key")))
    return met.groupBy("fp").agg(F.any_value("text").alias("text"))  # rows of one doc_id and one text


def _heads(batches: Iterator[pa.RecordBatch], p: int, q: int) -> Iterator[pa.RecordBatch]:
    """(fp, n, head): each class's first shingles in the global order, its prefix and up to as many more as were emitted."""
    for batch in batches:
        tokens, long, out = batch.column(2), batch.column(3), []
        for i, n in enumerate(batch.column(1).to_pylist()):
            own = tokens[i].values.to_numpy().view(np.uint64)
            known = len(own) == n  # else the long lists' shingles after the last short one are not all in hand
            if long[i].is_valid:
                heavy = np.sort(long[i].values.to_numpy().view(np.uint64))
                own = np.concatenate([own[~np.isin(own, heavy, assume_unique=True)], heavy[: len(heavy) * known]])
            k = prefix_length(n, p, q)
            out.append(own[: k + int(_extra(k))])
        counts = np.cumsum([0, *map(len, out)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(counts), pa.array(np.concatenate([np.zeros(0, np.uint64), *out]).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["fp", "n", "head"])


def overlaps(query: np.ndarray, sets: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Items that each of the sets, laid end to end, shares with the query; all are sorted and without repeats."""
    place = np.searchsorted(query, sets)
    place[place == len(query)] = 0
    return K.sums(query[place] == sets if len(query) else np.zeros(len(sets), bool), offs)


def _links(batches: Iterator[pa.RecordBatch], words: int, p: int, q: int, key: bytes) -> Iterator[pa.RecordBatch]:
    """Of rows (fpa, fpb, text of a, text of b) the links (a, b). The query of a run of equal fpb is hashed once."""
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        keep = np.zeros(len(a), bool)
        cuts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]])) if len(b) else np.zeros(1, np.int64)
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            _, query, _ = next(shingle_sets(batch.column(3).slice(x, 1), words, key))
            for first, sets, offs in shingle_sets(batch.column(2).slice(x, y - x), words, key):
                n = np.diff(offs)
                keep[x + first : x + first + len(n)] = (p + q) * overlaps(query, sets, offs) >= p * (len(query) + n)
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])


def class_links(docs: DataFrame, words: int, p: int, q: int, every: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, fp, text_key: xxhash64 of the text) of all documents, and links (a, b) between the keys of different linking classes, each once.

    Without ``every`` pairs of classes that other links connect already are not looked at: their components are the same.
    Keys ``fp`` are drawn anew in every call.
    """
    spark, key = docs.sparkSession, os.urandom(16)
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    wide, wide_at = written(docs.mapInArrow(lambda it: _emit(it, words, p, q, key), f"doc_id {kind}, n long, fp long, text_key long, tokens array<long>"), "shingles")
    rows, _ = written(wide.select("doc_id", "n", "fp", "text_key"), "documents")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("one")
    several = wide.where(F.col("n") >= fewest(p, q)).groupBy("fp")
    emitted, emitted_at = written(several.agg(one, F.min("n").alias("n"), F.any_value("tokens").alias("tokens"), F.lit(False).alias("whole")), "classes")
    discard(spark, wide_at)
    need = F.col("n") - F.ceil(F.col("n") * p / q) + 1
    heavy, counted, heavy_ats = spark.createDataFrame([], "token long"), emitted, []
    while True:
        # Counted among smallest hashes once, and among whole sets each time: a list is long if either says so.
        lists = counted.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("lists"))
        heavy, heavy_at = written(lists.where(F.col("lists") >= LONG_LIST).select("token").union(heavy).distinct(), "long-lists")
        heavy_ats.append(heavy_at)
        postings = emitted.select("fp", F.explode("tokens").alias("token"))
        long, long_at = written(postings.join(heavy, "token").groupBy("fp").agg(F.collect_list("token").alias("long")), "long-of")
        short_of = emitted.where(~F.col("whole")).join(long, "fp").where(F.size("tokens") - F.size("long") < need).select("fp", "one")
        short_of, short_at = written(short_of, "more-wanted")
        if short_of.isEmpty():
            break
        sets = _texts(docs, short_of).mapInArrow(lambda it: _whole(it, words, key), "fp long, every array<long>")
        more = emitted.join(sets, "fp", "left")
        more = more.select("fp", "one", "n", F.coalesce("every", "tokens").alias("tokens"), (F.col("whole") | F.col("every").isNotNull()).alias("whole"))
        old = (emitted_at, long_at, short_at)
        emitted, emitted_at = written(more, "emitted")
        counted = emitted.where("whole")
        for at in old:
            discard(spark, at)
    ordered = emitted.join(long, "fp", "left").select("fp", "n", "tokens", "long")
    heads, heads_at = written(ordered.mapInArrow(lambda it: _heads(it, p, q), "fp long, n long, head array<long>"), "heads")
    classes, classes_at = written(emitted.select("fp", "one"), "class-rows")
    for at in (emitted_at, long_at, short_at, *heavy_ats):
        discard(spark, at)
    places = heads.select("fp", "n", F.posexplode(F.slice("head", F.lit(1), need.cast("int"))).alias("place", "token"))
    # Each list's class of the earliest place is its centre: of near copies, the one with the fewest shingles of its own.
    centre = F.min(F.struct("place", "fp", "n")).alias("centre")
    lists = places.groupBy("token").agg(centre, F.count("*").alias("classes")).where("classes > 1").drop("classes")
    met, met_at = written(places.join(lists, "token"), "postings")
    stars = met.select("fp", "n", "place", F.col("centre.fp").alias("fpb"), F.col("centre.n").alias("nb"), F.col("centre.place").alias("placeb"))
    stars = stars.toDF("fpa", "na", "placea", "fpb", "nb", "placeb").where((F.col("fpa") != F.col("fpb")) & _may_link(p, q))
    verified = lambda pairs: _verified(docs, classes, _merged(pairs, heads, p, q), words, p, q, key)
    links = verified(stars.select("fpa", "fpb").distinct())
    # What the centres have not joined: classes of one list in different components.
    found = components(links)
    marked = met.drop("centre").join(found, F.col("fp") == F.col("node"), "left").drop("node").withColumn("component", F.coalesce("component", "fp"))
    if not every:
        split = marked.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
        marked = marked.join(split, "token")
    marked, marked_at = written(marked, "marked-postings")
    more = verified(_met_in_cells(marked, every, p, q))
    for at in (met_at, marked_at, heads_at, classes_at):
        discard(spark, at)
    if not every:
        return rows, links.union(more)
    return rows, more


def _met_in_cells(marked: DataFrame, every: bool, p: int, q: int) -> DataFrame:
    """Pairs (fpa, fpb) of one list that pass the length and position filters and lie in different components, unless ``every`` is wanted.

    The filters look at sizes and places only, so a list's cells of one size and place meet first: classes are met for
    those pairs of cells alone that pass, however long the list.
    """
    cell = ["n", "place"]
    cells = marked.groupBy("token", *cell).agg(F.min("component").alias("low"), F.max("component").alias("high"))
    x, y = (cells.select("token", *(F.col(c).alias(c + s) for c in (*cell, "low", "high"))) for s in "ab")
    ordered = F.struct("na", "placea") <= F.struct("nb", "placeb")
    apart = F.lit(True) if every else ~((F.col("lowa") == F.col("higha")) & (F.col("lowb") == F.col("highb")) & (F.col("lowa") == F.col("lowb")))
    pairs = x.join(y, "token").where(ordered & apart & _may_link(p, q)).select("token", "na", "placea", "nb", "placeb")
    a, b = (marked.select("token", *(F.col(c).alias(c + s) for c in ("fp", *cell, "component"))) for s in "ab")
    met = pairs.join(a, ["token", "na", "placea"]).join(b, ["token", "nb", "placeb"])
    same_cell = (F.col("na") == F.col("nb")) & (F.col("placea") == F.col("placeb"))
    met = met.where((F.col("fpa") < F.col("fpb")) | (~same_cell & (F.col("fpa") != F.col("fpb"))))
    met = met if every else met.where("componenta <> componentb")
    return met.select(F.least("fpa", "fpb").alias("fpa"), F.greatest("fpa", "fpb").alias("fpb")).distinct()


def _may_link(p: int, q: int):
    """Length and position filters of columns na, placea, nb, placeb, for the first shingle that two classes share."""
    bound = F.least(F.col("na") - F.col("placea"), F.col("nb") - F.col("placeb"))
    return (q * F.least("na", "nb") >= p * F.greatest("na", "nb")) & ((p + q) * bound >= p * (F.col("na") + F.col("nb")))


def _merged(pairs: DataFrame, heads: DataFrame, p: int, q: int) -> DataFrame:
    """The pairs (fpa, fpb) whose occurrences in the lists of both heads reach the required overlap less the lists set aside.

    Of two sets that share T shingles, take the one whose head ends first in the global order: what is shared within its
    head lies in the other's head too, and past it there are n - |head| at most.
    """
    a, b = (heads.select(*(F.col(c).alias(c + s) for c in ("fp", "n", "head"))) for s in "ab")
    aside = F.greatest(F.col("na") - F.size("heada"), F.col("nb") - F.size("headb"))
    shared = F.size(F.array_intersect("heada", "headb"))
    met = pairs.join(a, "fpa").join(b, "fpb")
    return met.where((p + q) * (shared + aside) >= p * (F.col("na") + F.col("nb"))).select("fpa", "fpb")


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, p: int, q: int, key: bytes) -> DataFrame:
    """Those of the pairs (fpa, fpb) that link, as (a, b)."""
    spark = docs.sparkSession
    pairs, pairs_at = written(pairs, "pairs")
    nodes = pairs.select(F.explode(F.array("fpa", "fpb")).alias("fp")).distinct()
    wanted, wanted_at = written(classes.join(nodes, "fp", "left_semi"), "wanted")
    texts, texts_at = written(_texts(docs, wanted), "texts")
    left = pairs.join(texts.select(F.col("fp").alias("fpa"), F.col("text").alias("ta")), "fpa")
    both = left.join(texts.select(F.col("fp").alias("fpb"), F.col("text").alias("tb")), "fpb").select("fpa", "fpb", "ta", "tb")
    links, _ = written(both.mapInArrow(lambda it: _links(it, words, p, q, key), "a long, b long"), "links")
    for at in (pairs_at, wanted_at, texts_at):
        discard(spark, at)
    return links


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of links (a, b): the smallest node that can be reached. Alternates large-star and small-star."""
    spark = links.sparkSession

    def stars(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        back = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        near = both.union(back)
        near = near if large else near.where("v < u")
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = near.join(least, "u")
        moved = joined.where("v > u").select("m", F.col("v").alias("b")) if large else joined.select("m", F.col("v").alias("b"))
        kept = moved if large else moved.union(least.select("m", F.col("u").alias("b")))
        return kept.where("m <> b").select(F.least("m", "b").alias("a"), F.greatest("m", "b").alias("b")).distinct()

    def sign(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    edges, at = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = sign(edges)
    while True:
        wide, wide_at = written(stars(edges, True), "large-star")
        edges, new = written(stars(wide, False), "small-star")
        discard(spark, at)
        discard(spark, wide_at)
        at, now = new, sign(edges)
        if now == before:
            break
        before = now
    heads = edges.select(F.col("a").alias("node")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(heads.select("node", F.col("node").alias("component")))


def jaccard_components(docs: DataFrame, words: int = 3, p: int = 9, q: int = 10) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: size of its set, and the smallest doc_id that links reach from it.

    Null and empty texts have empty sets and are components of their own. Equal sets link whatever their order
    and repeats. A doc_id of several rows stands for each of them; null ones name no component before others do. Texts of any
    length are taken whole, an empty table gives an empty one. Sets are of 64-bit hashes under a key drawn anew in every
    call: two different shingles, or the sets of two classes, are taken for one with probability near 2**-64. Other
    columns are left out, whatever their names.
    """
    rows, links = class_links(docs, words, p, q, every=False)
    found = components(links)
    least = rows.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least"))
    grouped = least.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    heads = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.join(heads, "component").select("fp", "component_id")
    some = rows.where("n > 0").join(named, "fp").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return some.union(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def component_heads(docs: DataFrame, words: int, p: int, q: int) -> DataFrame:
    """(doc_id, text_key) of one row of each component, the least; text_key is the xxhash64 of the text.

    Rows of one doc_id whose texts lie in different components are told apart by it. Rows without doc_id head nothing.
    """
    rows, links = class_links(docs, words, p, q, every=False)
    rows = rows.where("doc_id is not null")
    joined = rows.where("n > 0").join(components(links), F.col("fp") == F.col("node"), "left")
    some = joined.groupBy(F.coalesce("component", "fp").alias("component")).agg(F.min(F.struct("doc_id", "text_key")).alias("head"))
    return some.select("head.*").union(rows.where("n = 0").select("doc_id", "text_key").distinct())
