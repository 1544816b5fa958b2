"""Collocations: n-gram counts from suffix arrays of word ids, merged by key, and scored by exact integer arithmetic."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewright.llm import kernels as K
from edgewright.llm.shared import written
from edgewright.operators.graph import with_ids

#: What ends a piece, and what lies between words besides.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP = SEPARATOR.copy()
GAP[[0x20, 0x09]] = True
#: Bytes of text of one language that share a suffix array, unless a single text is longer; about so many bytes fall to one cell of the merge.
SHARD_BYTES, CELL_BYTES = 8 << 20, 4 << 20
#: Cells of a shard that are given on together.
CELLS = 8
UNKNOWN = "und"

_PARTS = "cell int, lang string, n int, keys array<bigint>, counts array<int>, words array<string>"
_MERGED = "lang string, n int, key array<bigint>, f long, word string"


def suffix_intervals(ids: np.ndarray, piece: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, places, counts) for n = 1 to ``longest``: a place of each distinct n-gram of words, and how often it occurs.

    ``ids`` are the words' ids and ``piece`` the piece of each, ascending; an n-gram lies within a piece. The suffix array is built by prefix
    doubling: suffixes are ranked by their first word, then by pairs of ranks 1, 2, 4, ... words apart, until the ranks cover ``longest``
    words; more words would order suffixes whose intervals are not asked for. Neighbours' common prefixes, cut at the end of a
    piece, bound the LCP intervals: a run of neighbours that share n words is an n-gram, and its length the count.
    """
    m = len(ids)
    if not m:
        return
    shift = np.concatenate([[0], np.cumsum(piece[1:] != piece[:-1])])
    at = np.arange(m) + shift  # a terminator stands between pieces
    last = int(shift[-1])
    del shift
    text = np.zeros(m + last + 2 * longest, dtype=np.int64)
    text[at] = np.unique(ids, return_inverse=True)[1] + 1
    rank, width = text, 1
    while width < longest:
        ahead = np.concatenate([rank[width:], np.zeros(width, np.int64)])
        rank, width = np.unique(rank * (int(rank.max()) + 1) + ahead, return_inverse=True)[1].astype(np.int64), 2 * width
    suffixes = np.argsort(rank[at], kind="stable")
    places = at[suffixes]
    del rank, at
    common, shared, room = np.zeros(m, np.int64), np.ones(m - 1, dtype=bool), np.zeros(m, np.int64)
    inside = np.ones(m, dtype=bool)
    for k in range(longest):
        word = text[places + k]
        inside &= word > 0
        room += inside
        shared &= (word[1:] == word[:-1]) & inside[1:]
        common[1:] += shared
    for n in range(1, longest + 1):
        begin = np.flatnonzero(common < n)
        counts = np.diff(np.append(begin, m))
        whole = room[begin] >= n
        yield n, suffixes[begin[whole]], counts[whole]


def _parts(batches: Iterator[pa.RecordBatch], longest: int, cells: int, key: bytes) -> Iterator[pa.RecordBatch]:
    """Counts of the n-grams of runs of texts (lang, text), one row for each cell, language and n."""
    held: dict[str, tuple[list[pa.Array], int]] = {}

    def counted(lang: str) -> Iterator[pa.RecordBatch]:
        for _, _, raw, offs in K.chunks(pa.chunked_array(held.pop(lang)[0]).combine_chunks(), SHARD_BYTES):
            buf = K.LOWER[raw]
            starts, ends, first = K.words(buf, offs, GAP)
            if not len(starts):
                continue
            before = np.concatenate([[0], np.cumsum(SEPARATOR[buf])])[starts] + K.owners(first)  # rises at each separator and text
            ids = K.Spans(buf, key).hash(starts, ends)
            for n, places, counts in suffix_intervals(ids, before, longest):
                if not len(places):  # pieces of single words have no longer phrases
                    continue
                words = np.stack([ids[places + k] for k in range(n)])
                cell = np.zeros(len(places), np.uint64)
                for w in words:
                    cell = K.mix(cell * np.uint64(31) + w)
                cell = (cell % np.uint64(cells)).astype(np.int64)
                order = np.argsort(cell, kind="stable")
                found, begins = np.unique(cell[order], return_index=True)
                begins = np.append(begins, len(order))
                flat = np.concatenate([words[:, order[a:b]].reshape(-1) for a, b in zip(begins[:-1], begins[1:], strict=True)]).view(np.int64)
                texts = None
                if n == 1:
                    s, e = starts[places[order]], ends[places[order]]
                    offsets = np.concatenate([[0], np.cumsum(e - s)]).astype(np.int32)
                    data = K.ragged(buf, s, e - s)
                    texts = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.StringArray.from_buffers(len(s), pa.py_buffer(offsets), pa.py_buffer(data)))
                made = pa.RecordBatch.from_arrays(
                    [
                        pa.array(found.astype(np.int32)),
                        pa.array([lang] * len(found), pa.string()),
                        pa.array(np.full(len(found), n, np.int32)),
                        pa.ListArray.from_arrays(pa.array((begins * n).astype(np.int32)), pa.array(flat)),
                        pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(counts[order].astype(np.int32))),
                        texts if texts is not None else pa.nulls(len(found), pa.list_(pa.string())),
                    ],
                    names=["cell", "lang", "n", "keys", "counts", "words"],
                )
                del words, cell, order, flat, texts
                for a in range(0, made.num_rows, CELLS):  # a few cells at a time cross to the JVM
                    yield made.slice(a, CELLS)
            del made, ids, before, starts, ends
            K.give_back()  # several workers share an executor's memory

    waiting = 0
    for batch in batches:
        for lang in pc.unique(batch.column(0)).to_pylist():
            texts = batch.column(1).filter(pc.equal(batch.column(0), lang)).cast(pa.large_string())
            size = (pc.sum(pc.binary_length(texts)).as_py() or 0) + len(texts)
            parts, n = held.get(lang, ([], 0))
            held[lang] = ([*parts, texts], n + size)
            waiting += size
            if n + size >= SHARD_BYTES:
                waiting -= n + size
                yield from counted(lang)
        if waiting >= 2 * SHARD_BYTES:  # many languages, none of them large
            waiting = 0
            for lang in list(held):
                yield from counted(lang)
    for lang in list(held):
        yield from counted(lang)
    K.give_back()


def _merged(table: pa.Table, least: int) -> pa.Table:
    """Totals of a cell's n-grams that occur ``least`` times at least; for n = 0 the occurrences of all words of a language."""
    out = []
    for lang in pc.unique(table.column("lang")).to_pylist():
        own = table.filter(pc.equal(table.column("lang"), lang))
        for n in pc.unique(own.column("n")).to_pylist():
            rows = own.filter(pc.equal(own.column("n"), n)).combine_chunks()
            counts = pc.list_flatten(rows.column("counts").combine_chunks()).to_numpy().astype(np.int64)
            keys = [k.values.to_numpy().reshape(n, -1) for k in rows.column("keys").combine_chunks()]
            keys = np.concatenate(keys, axis=1)
            order = np.lexsort(keys[::-1])
            keys = keys[:, order]
            new = np.ones(len(order), dtype=bool)
            new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
            begin = np.flatnonzero(new)
            total = np.add.reduceat(counts[order], begin)
            often = total >= least
            begin, f = begin[often], total[often]
            words = pa.nulls(len(begin), pa.string())
            if n == 1:
                words = pc.list_flatten(rows.column("words").combine_chunks()).cast(pa.string()).take(pa.array(order[begin]))
                begin_all = pa.ListArray.from_arrays(pa.array([0, 0], pa.int32()), pa.array([], pa.int64()))
                out.append(pa.table([pa.array([lang], pa.string()), pa.array([0], pa.int32()), begin_all, pa.array([int(counts.sum())]), pa.nulls(1, pa.string())], names=["lang", "n", "key", "f", "word"]))
            flat = np.ascontiguousarray(keys[:, begin].T).reshape(-1)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(begin) + 1, dtype=np.int32) * n), pa.array(flat))
            out.append(pa.table([pa.array([lang] * len(begin), pa.string()), pa.array(np.full(len(begin), n, np.int32)), listed, pa.array(f), words], names=["lang", "n", "key", "f", "word"]))
    K.give_back()
    return pa.concat_tables(out)


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10) -> DataFrame:
    """(lang, n, key, f, word): every phrase of 1 to ``longest`` words that occurs ``least`` times in its language, and its occurrences.

    ``key`` lists the words' 64-bit hashes under a key drawn for each call; ``word`` is the text for n = 1. Rows of n = 0 hold parts of the number of all words of a language.
    Each shard of a task is counted from its suffix array, so a phrase costs a row a shard however often it stands there; shards meet in cells
    by the hash of the whole phrase, so no frequent word, pair or language gathers in one cell. The number of cells grows with the texts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).head()[0] or 0
    cells, key = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // CELL_BYTES), os.urandom(16)
    parts = rows.mapInArrow(lambda it: _parts(it, longest, cells, key), _PARTS)
    return parts.groupBy("cell").applyInArrow(lambda table: _merged(table, least), _MERGED)


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of 2 to ``longest`` words of each language.

    Texts are lower-cased (A-Z), split at ``[.,;:!?]`` and line ends into pieces and those at spaces and tabs into words. A phrase that occurs
    a >= ``least`` times is cut where floor(1000000 * a * a / (l * r)) is least, at the first of equal places; l and r are the occurrences of its two parts. It is dropped if a
    longer such phrase around it occurs at least half as often. Order is score, occurrences (both falling), phrase in bytes.
    Decimals of 38 digits hold the products exactly up to 10**15 occurrences; beyond that the cast fails rather than errs.

    A null language is ``und``; null and empty texts have no words. Repeated rows count each. A text longer than a shard is one shard.
    Ties are told apart by the phrase. An empty table gives no rows. Other columns are left out, whatever their names.
    """
    counts, _ = written(phrase_counts(docs, longest, least), "phrase-counts")
    total = counts.where("n = 0").groupBy("lang").agg(F.sum("f").alias("n_words"))
    # A longer phrase around one occurs no more often than one of just one more word around it, so that one decides.
    around = F.explode(F.array_distinct(F.array(F.expr("slice(key, 1, n - 1)"), F.expr("slice(key, 2, n - 1)")))).alias("key")
    longer = counts.where("n > 2").select("lang", around, "f").groupBy("lang", "key").agg(F.max("f").alias("f_longer"))
    kept = counts.where("n > 1").join(longer, ["lang", "key"], "left").where("f_longer is null or 100 * f_longer < 50 * f").select("lang", "n", "key", F.col("f").alias("a"))
    kept, _ = written(kept, "phrase-candidates")
    # All that a candidate asks for are counts of shorter phrases: both parts of each cut, and its words for their text.
    ask = lambda k, side, part: F.when(F.col("n") >= (k if side == "w" else k + 1), F.struct(F.lit(side).alias("side"), F.lit(k).alias("k"), F.expr(part).alias("part")))
    asked = [ask(k, "l", f"slice(key, 1, {k})") for k in range(1, longest)] + [ask(k, "r", f"slice(key, {k + 1}, n - {k})") for k in range(1, longest)]
    asked += [ask(k, "w", f"slice(key, {k}, 1)") for k in range(1, longest + 1)]
    lookups = kept.withColumn("ask", F.explode(F.array_compact(F.array(*asked)))).select("lang", "key", "a", "ask.*")
    answers = counts.where("n > 0").select("lang", F.col("key").alias("part"), "f", "word")
    answered = lookups.join(answers, ["lang", "part"]).groupBy("lang", "key", "a").agg(F.sort_array(F.collect_list(F.struct("side", "k", "f", "word"))).alias("parts"))
    side = lambda s: F.filter("parts", lambda p: p["side"] == s)
    wide = lambda c: c.cast("decimal(15,0)")
    cuts = F.zip_with(
        side("l"),
        side("r"),
        lambda x, y: F.struct(F.call_function("div", wide(F.col("a")) * wide(F.col("a")) * F.lit(1000000).cast("decimal(7,0)"), wide(x["f"]) * wide(y["f"])).alias("score"), x["k"].alias("k"), x["f"].alias("l"), y["f"].alias("r")),
    )
    scored = answered.select("lang", "a", F.array_min(cuts).alias("cut"), F.array_join(F.transform(side("w"), lambda p: p["word"]), " ").alias("phrase"))
    rows = scored.join(total, "lang").select("lang", "phrase", "a", "cut.l", "cut.r", F.col("n_words").alias("n"), F.col("cut.score").cast("long").alias("score"))
    ordered = with_ids(rows, F.col("lang"), F.col("score").desc(), F.col("a").desc(), F.col("phrase"), name="at")
    begins = ordered.groupBy("lang").agg(F.min("at").alias("begin"))
    ranked = ordered.join(begins, "lang").withColumn("rank", F.col("at") - F.col("begin") + 1)
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle() -> str:
    """The collocations of at most three words as SQL."""
    return r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) as piece from documents),
split as (select row_number() over () as piece, lang, regexp_extract_all(piece, '[^ \t]+') as w from pieces),
words as (select piece, lang, unnest(w) as w, unnest(range(len(w))) as place from split),
ahead as (select lang, w as w1, lead(w, 1) over p as w2, lead(w, 2) over p as w3 from words window p as (partition by piece order by place)),
grams as (select lang, 1 as n, w1 as phrase from ahead union all select lang, 2, w1 || ' ' || w2 from ahead where w2 is not null
  union all select lang, 3, w1 || ' ' || w2 || ' ' || w3 from ahead where w3 is not null),
counts as (select lang, n, phrase, count(*) as a from grams group by lang, n, phrase),
total as (select lang, cast(sum(a) as bigint) as n from counts where n = 1 group by lang),
often as (select lang, n, phrase, string_split(phrase, ' ') as w, a from counts where a >= 10),
longer as (select lang, phrase, max(a) as a from (
  select lang, array_to_string(w[1:2], ' ') as phrase, a from often where n = 3 union all select lang, array_to_string(w[2:3], ' '), a from often where n = 3) group by lang, phrase),
cuts as (select o.lang, o.phrase, o.a, k.k, l.a as l, r.a as r, cast((1000000::hugeint * o.a * o.a) // (l.a::hugeint * r.a) as bigint) as score
  from often o join (values (1), (2)) k(k) on k.k < o.n
  join often l on l.lang = o.lang and l.phrase = array_to_string(o.w[1:k.k], ' ')
  join often r on r.lang = o.lang and r.phrase = array_to_string(o.w[k.k + 1:o.n], ' ')
  left join longer x on x.lang = o.lang and x.phrase = o.phrase and o.n = 2
  where x.a is null or 100 * x.a < 50 * o.a),
least as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from least)
select r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score from ranked r join total t on t.lang = r.lang where r.rank <= 2000"""
