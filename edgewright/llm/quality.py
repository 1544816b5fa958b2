"""Quality rules: length-specific bands of zstandard compression ratios over whole documents and fixed chunks."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from edgewright.llm import bpe
from edgewright.llm import kernels as K

#: (UTF-8 bytes from, lowest and highest ratio of plain to compressed size that is accepted) where no labelled
#: rows tell more. Short texts pay the frame's fixed bytes, so their ratios lie lower; up to 200 bytes nothing is too dense.
BANDS = (
    (0, 0.0, 2.4),
    (200, 0.9, 2.3),
    (400, 1.1, 2.4),
    (800, 1.25, 2.5),
    (1600, 1.4, 2.65),
    (3200, 1.5, 2.8),
    (6400, 1.6, 3.0),
    (12800, 1.6, 3.3),
)
#: Chunks of so many bytes, the last one shorter, must each lie in the band of their own length, but for this share of them.
CHUNK = 4096
CHUNK_SHARE = 0.25
#: Bands are fitted to all documents labelled good, by steps of half an octave of length that hold enough texts and chunks: the TAIL
#: quantiles of their ratios (counted to RATIO_DIGITS decimals, so that a step's counts stay few), moved out by MARGIN times their distance from the median.
RATIO_DIGITS = 4
STEPS, LEAST_PIECES = 2, 30
TAIL, MARGIN = 0.005, 0.1
LEVEL = 3
#: Fixed values of the base rules.
LEAST_WORDS = 50
MOST_REPEATED = 50
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[*b"#*$%&|<>"]] = True

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, ratio double, n_chunks long, n_bad_chunks long, reason string"
)
_FIELDS = [c.split() for c in SCHEMA.split(", ")]
_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}
NAMES = [n for n, _ in _FIELDS]


class Bands(NamedTuple):
    """Limits at the middles of length steps (log2 of bytes, ascending); none at all leaves BANDS alone."""

    at: tuple[float, ...] = ()
    low: tuple[float, ...] = ()
    high: tuple[float, ...] = ()

    def limits(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest ratio for each length, linear in log length; BANDS beyond the steps."""
        step = np.searchsorted([b[0] for b in BANDS], n, "right") - 1
        low, high = np.array([b[1] for b in BANDS])[step], np.array([b[2] for b in BANDS])[step]
        if not self.at:
            return low, high
        x = np.log2(np.maximum(n, 1))
        inside = (x >= self.at[0] - 0.5 / STEPS) & (x < self.at[-1] + 0.5 / STEPS)
        return np.where(inside, np.interp(x, self.at, self.low), low), np.where(inside, np.interp(x, self.at, self.high), high)


def base_counts(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The base rules' counts of each text of a chunk."""
    starts, ends, first = K.words(buf, offs)
    spans = K.Spans(buf)
    in_word = np.zeros(len(buf) + 1, dtype=np.int8)
    in_word[starts] = 1
    np.add.at(in_word, ends, -1)
    in_word = np.cumsum(in_word[:-1], dtype=np.int8).astype(bool)
    leads = (buf & 0xC0) != 0x80

    cuts = np.union1d(np.flatnonzero(buf == 10) + 1, offs)
    line_from, line_to = cuts[:-1], cuts[1:].copy()
    line_to -= (line_to > line_from) & (buf[line_to - 1] == 10) if len(cuts) > 1 else 0
    worded = np.searchsorted(starts, line_to) > np.searchsorted(starts, line_from)
    line_from, line_to = line_from[worded], line_to[worded]
    row = np.searchsorted(offs, line_from, "right") - 1
    key = spans.hash(line_from, line_to) + K.mix(row.astype(np.uint64))
    _, one = np.unique(key, return_index=True)
    dup = np.bincount(row, minlength=len(offs) - 1) - np.bincount(row[one], minlength=len(offs) - 1)

    grams, begins = K.shingles(spans.hash(starts, ends), first, 3)
    owner = K.owners(begins)
    _, which, times = np.unique(grams + K.mix(owner.astype(np.uint64)), return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[which] > 1)
    place = again - begins[owner[again]] + first[owner[again]]
    marked = np.zeros(len(starts), dtype=bool)
    for k in range(3):
        marked[place + k] = True
    return {
        "n_words": np.diff(first),
        "word_chars": K.sums(leads & in_word, offs),
        "n_symbols": K.sums(_SYMBOL[buf], offs),
        "n_dup_lines": dup,
        "n_repeat_words": K.sums(marked, first),
    }


def _failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    n = counts["n_words"]
    return (n < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * n)


def _measure(text: memoryview, packer: zstandard.ZstdCompressor) -> tuple[list[int], list[float]]:
    """Lengths and ratios of the whole text and of each of its chunks; a text of one chunk is that chunk."""
    n = len(text)
    if not n:
        return [0], [0.0]
    parts = [text] + [text[k : k + CHUNK] for k in range(0, n, CHUNK) if n > CHUNK]
    sizes = [len(part) for part in parts]
    ratios = [size / len(packer.compress(part)) for size, part in zip(sizes, parts, strict=True)]
    return (sizes, ratios) if n > CHUNK else (sizes * 2, ratios * 2)


def _verdict(sizes: list[int], ratios: list[float], bands: Bands) -> tuple[float, int, int, str | None]:
    """Ratio of the whole text, its chunks, those out of their band, and why it is rejected."""
    if not sizes[0]:
        return 0.0, 0, 0, None
    low, high = bands.limits(np.array(sizes))
    above, below = np.array(ratios) > high, np.array(ratios) < low
    n_chunks, bad = len(sizes) - 1, int((above | below)[1:].sum())
    if above[0]:
        return ratios[0], n_chunks, bad, "repetitive"
    if below[0]:
        return ratios[0], n_chunks, bad, "incompressible"
    return ratios[0], n_chunks, bad, "chunks" if bad > CHUNK_SHARE * n_chunks else None


def _pieces(column: pa.Array) -> pa.Array:
    """Lengths and ratios of each text that passes the base rules, and of the chunks of the longer ones; none of the others."""
    bpe.forget()
    packer, counts, sizes, ratios = zstandard.ZstdCompressor(level=LEVEL), [0], [], []
    for _, _, buf, offs in K.chunks(column):
        view = memoryview(np.ascontiguousarray(buf))
        for i, failed in enumerate(_failed(base_counts(buf, offs)).tolist()):
            if not failed:
                n, ratio = _measure(view[offs[i] : offs[i + 1]], packer)
                once = len(n) if n[0] > CHUNK else 1
                sizes += n[:once]
                ratios += ratio[:once]
            counts.append(len(sizes))
    pieces = pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(ratios, pa.float64())], names=["size", "ratio"])
    return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pieces)


def fit_bands(docs: DataFrame, labels: DataFrame, text: str = "text") -> Bands:
    """The bands of all documents that ``labels`` (doc_id, quality) call good; a row for each step of length comes to the driver.

    Texts are measured where they lie and only their lengths and ratios meet the labels.
    """

    def measure(column: pa.Array) -> pa.Array:
        return _pieces(column)

    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    measured = docs.select("doc_id", F.arrow_udf(measure, "array<struct<size: bigint, ratio: double>>", ArrowUDFType.SCALAR)(docs[text]).alias("pieces"))
    pieces = measured.where(F.size("pieces") > 0).join(good, "doc_id", "left_semi").select(F.explode("pieces").alias("p"))
    counted = pieces.groupBy(F.floor(F.log2("p.size") * STEPS).alias("step"), F.round("p.ratio", RATIO_DIGITS).alias("ratio")).agg(F.count("*").alias("n"))
    tails = F.percentile("ratio", F.array(F.lit(TAIL), F.lit(0.5), F.lit(1 - TAIL)), F.col("n")).alias("q")
    steps = counted.groupBy("step").agg(tails, F.sum("n").alias("n"))
    found = sorted((r.step, *r.q) for r in steps.where(F.col("n") >= LEAST_PIECES).collect())
    at = tuple((step + 0.5) / STEPS for step, *_ in found)
    return Bands(at, tuple(lo - MARGIN * (mid - lo) for _, lo, mid, _ in found), tuple(hi + MARGIN * (hi - mid) for _, _, mid, hi in found))


def _verdicts(column: pa.Array, bands: Bands) -> pa.Array:
    """The columns of SCHEMA of each text, as structs."""
    bpe.forget()
    packer, parts = zstandard.ZstdCompressor(level=LEVEL), []
    for _, _, buf, offs in K.chunks(column):
        out = base_counts(buf, offs)
        failed = _failed(out)
        view = memoryview(np.ascontiguousarray(buf))
        seen = [_verdict(*_measure(view[x:y], packer), bands) for x, y in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        reason = ["base" if f else s[3] for f, s in zip(failed.tolist(), seen, strict=True)]
        columns = [pa.array(out[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        columns += [pa.array(failed), pa.array([r is None for r in reason], pa.bool_()), pa.array([s[0] for s in seen], pa.float64())]
        columns += [pa.array([s[1] for s in seen], pa.int64()), pa.array([s[2] for s in seen], pa.int64()), pa.array(reason, pa.string())]
        parts.append(pa.StructArray.from_arrays(columns, names=NAMES))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([(n, _ARROW[k]) for n, k in _FIELDS]))


def verdict(text: Column, bands: Bands = Bands()) -> Column:
    """The verdict on a text as a struct of SCHEMA. Only the text goes to Python; the row's other columns stay where they are."""

    def judge(column: pa.Array) -> pa.Array:
        return _verdicts(column, bands)

    return F.arrow_udf(judge, f"struct<{SCHEMA}>", ArrowUDFType.SCALAR)(text)


def compression_bands(docs: DataFrame, text: str = "text", keep: list[str] | None = None, bands: Bands = Bands()) -> DataFrame:
    """Judge every document; returns the columns ``keep`` and those of SCHEMA, one row for each input row.

    Null and empty texts have no words and fail the base rule. A text is rejected when its ratio of
    plain to zstandard size leaves the band of its length (above: repetitive; below: incompressible) or
    when over CHUNK_SHARE of its chunks leave theirs; ``bands`` comes of fit_bands. Texts of any length are judged whole, one
    at a time beyond CHUNK_BYTES. Repeated rows are judged alike, each on its own; no row is compared with another. An empty
    table gives an empty one. ``keep`` columns named like a result column are refused, other columns are left out.
    """
    keep = ["doc_id"] if keep is None else keep
    if clash := set(NAMES) & set(keep):
        raise ValueError(f"columns to keep clash with results: {sorted(clash)}")
    judged = docs.select(*(docs[k] for k in keep), verdict(docs[text], bands).alias("__verdict"))
    return judged.select(*keep, *(F.col("__verdict")[n].alias(n) for n in NAMES))


def passing(docs: DataFrame, text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The rows of ``docs``, all columns, that the base rules and the bands keep."""
    return docs.where(verdict(docs[text], bands)["kept"])
