"""Operators on single texts, held against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from edgewright.llm import bpe, bpe_codec, catalog, kernels, licences, media, quality, token_io, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, " ", "\n\n", "a", "a b", "é ü\tñ  日本", "x" * 5000, "# * $ % & | < > no", "it's we'll they'Ve 's\n's", "<|endoftext|> a<|endoftext|>", "\x00\x00 \x1c\x85 b", "a b c " * 300]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["the", "cat", "über", "of", "12", "idiot,", "a", "ñ", "!!", "mit", "license"]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 200))) for _ in range(30)]
    lines = ["\n".join(rng.choice(["one line", "", "two", "  "]) for _ in range(rng.randint(1, 9))) for _ in range(20)]
    return [*ODD, *made, *lines, *made[:3]]


def frame(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_base_counts(spark, texts):
    got = {r.doc_id: r for r in quality.compression_bands(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        text = text or ""
        words = WORD.findall(text)
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        marked = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
        lines = [line for line in text.split("\n") if WORD.search(line)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, repr(text)[:80]
        assert r.base_failed == (len(words) < 50 or 100 * len(marked) > 50 * len(words))
        assert not (r.base_failed and r.kept)


def test_bands_tell_repetition_and_noise_from_prose(spark):
    rng = random.Random(1)
    noise = " ".join("".join(chr(rng.randint(33, 2000)) for _ in range(9)) for _ in range(300))
    near = " ".join(f"{'again' * 5}{i}" for i in range(400))
    got = {r.doc_id: r.reason for r in quality.compression_bands(frame(spark, [noise, near])).collect()}
    assert got == {0: "incompressible", 1: "repetitive"}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1")
    judged = quality.compression_bands(catalog.documents(spark, "/root/testdata/sf0.01")).join(labels, "doc_id").where("not base_failed")
    assert judged.where("kept").count() >= 0.99 * judged.count()


def test_bands_part_low_quality_from_good(spark):
    docs = catalog.documents(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("quality in (0, 1)")
    held = labels.withColumn("held", toxicity.held_out(labels.doc_id))
    bands = quality.fit_bands(docs, held.where("not held"))
    rows = quality.compression_bands(docs, bands=bands).join(held, "doc_id").where("not base_failed").select("quality", "held", "kept").collect()
    low, good = ([r.kept for r in rows if r.quality == q and (q == 0 or r.held)] for q in (0, 1))
    assert len(low) > 200 and len(good) > 200
    assert low.count(False) >= 0.75 * len(low)
    assert good.count(True) >= 0.98 * len(good)


def test_chunks_and_tails_are_judged_by_their_length(spark):
    bands = quality.Bands((1.0, 20.0), (0.0, 0.0), (0.0, 9.0))
    low, high = bands.limits(np.array([1, 2, 4096, 1 << 20]))
    assert low.tolist()[1:] == [0, 0, 0] and np.allclose(high[1:], [0, 9 * 11 / 19, 9])
    rng = random.Random(5)
    prose = lambda n: "".join(rng.choice("abcdefghijklmnop   ") for _ in range(n))
    tail = prose(4096) + "%" * 4000
    got = [quality.compression_bands(frame(spark, [t])).first() for t in (prose(800), prose(4096), tail, prose(4097), prose(40960) + "%" * 4000)]
    assert [(r.n_chunks, r.n_bad_chunks) for r in got] == [(1, 0), (1, 0), (2, 1), (2, 0), (11, 1)]
    assert got[2].n_bad_chunks > quality.CHUNK_SHARE * got[2].n_chunks


def test_bpe_equals_the_library(texts):
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for trie in (False, True):
        encode, got = bpe.Encoder(PATH, trie), []
        for a, b, buf, offs in kernels.chunks(pa.array(texts, pa.string()), 700):
            ids, begins = encode.ids(buf, offs)
            got += [ids[begins[k] : begins[k + 1]].tolist() for k in range(b - a)]
        assert got == want


def test_codec_digests_and_round_trip(spark, texts):
    docs, library = frame(spark, texts), Tokenizer.from_file(PATH)
    for r in bpe_codec.encode_decode(docs, PATH).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe_codec.decode_ids(bpe_codec.encode_ids(docs, PATH), PATH)
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_orc_ids(spark, texts, tmp_path):
    docs, library, start = frame(spark, texts), Tokenizer.from_file(PATH), 0
    rows = sorted(token_io.token_file_digest(docs, PATH).collect())
    assert len(rows) == len(texts)
    for r in rows:
        ids = [*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    token_io.write_ids(docs, PATH, str(tmp_path / "ids"))
    one = token_io.read_ids(spark, str(tmp_path / "ids")).where("doc_id = 5").collect()
    assert [r.doc_id for r in one] == [5]


def test_motion_jpeg_keeps_bytes(spark, texts):
    rows = media.media_digests(media.store_as_avi(frame(spark, texts))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
    noise = np.random.default_rng(0).integers(0, 256, 64 * 300, dtype=np.uint8).tobytes()
    assert media.analyse(media.write_avi([noise, b"\xff" * 64, b"\0" * 6400]))[0][0] == noise


def test_shots_and_clips(spark):
    calm, bright = bytes([0] * 64) * 64, bytes([120] + [0] * 63) * 64
    movie = media.write_avi([calm * 5 + bright * 5])
    assert media.analyse(movie)[0][1] == [(0, 4), (5, 9)]
    found = media.clips(spark.createDataFrame([(1, bytearray(movie[0])), (2, None)], "doc_id long, media binary")).collect()
    assert [(r.doc_id, r.clip, r.first_frame, r.last_frame, round(r.start_s, 2), round(r.end_s, 2)) for r in found] == [(1, 0, 0, 4, 0.0, 0.2), (1, 1, 5, 9, 0.2, 0.4)]


def test_flat_frame_decodes_to_its_grey():
    coefficients, pixels = media.decode_frames(*(lambda m: (m, media.parse_avi(m).frames))(media.write_avi([bytes([80] + [0] * 63)])[0]))
    assert coefficients[0][0][0] == 80
    assert set(pixels[0][0].tolist()) == {138}  # 128 + 80 / 8


def test_license_scan(spark, texts):
    more = ["Released under the MIT License.", "under the mit license, Under the MIT-license; the mit license", "Apache License, Version 2 and cc-by-nc", "x " * 30 + "Licensed under CC BY-NC 4.0. " + "y " * 30]
    more.append("This work is licensed under the GNU General Public License, version 3.")
    every = [*texts, *more]
    got = {r.doc_id: r for r in licences.scan_licenses(frame(spark, every)).collect()}
    assert len(got) == len(every)
    lower = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
    for i, text in enumerate(every):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
        at = [(k, label) for p, label in licences.PHRASES.items() for k in range(len(words)) if words[k : k + p.count(" ") + 1] == p.split()]
        starts = [k for k, _ in at]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        labels = {x for _, x in at}
        for b in range(0, len(words), licences.STRIDE):
            block = set(words[b : b + 2 * licences.STRIDE])
            labels |= {label for t, label in licences.TEMPLATES if len(block & set(t.split())) >= licences.CONTAINED * len(set(t.split()))}
        assert r.labels == ",".join(sorted(labels))
    assert [got[len(texts) + k].labels for k in range(5)] == ["mit", "mit", "apache-2,cc-by-nc", "cc-by-nc", "gpl-3"]


def test_toxicity_learns_words_and_their_misspellings(spark):
    rng = random.Random(2)
    plain = ["river", "stone", "walk", "green", "paper", "cloud", "table", "music", "north", "sugar"]
    bad = ["horrible", "disgusting", "worthless"]

    def text(toxic):
        words = [rng.choice(plain) + rng.choice(["", "s", "ing"]) for _ in range(rng.randint(5, 60))]
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        return " ".join(words)

    labels = [i % 3 == 0 for i in range(600)]
    model = toxicity.train([text(x) for x in labels], [int(x) for x in labels], 0.33)
    docs = frame(spark, ["green stone walk", "stone horible cloud", "paper disgustin table", "walk worthless north", "", None])
    scored = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert [scored[i].predicted for i in range(4)] == [0, 1, 1, 1]
    assert scored[4].score == scored[5].score and 0 <= scored[4].score <= 1


def test_toxicity_held_out_accuracy(spark):
    rows = catalog.op7_subword_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    truth, scores = np.array([r.toxic for r in rows]), np.array([r.score for r in rows])
    assert toxicity.auc(scores, truth) > 0.9
    assert all(toxicity.crc_fold(r.doc_id) == 0 for r in rows)


def test_toxicity_without_labels(spark):
    docs = frame(spark, ["a", None])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()} == {0}


def test_empty_tables(spark):
    none = frame(spark, ["x"]).where("doc_id < 0")
    for result in (
        quality.compression_bands(none),
        licences.scan_licenses(none),
        token_io.token_file_digest(none, PATH),
        bpe_codec.encode_decode(none, PATH),
        media.media_digests(media.store_as_avi(none)),
    ):
        assert result.count() == 0


def test_clashing_names_are_refused(spark):
    docs = frame(spark, ["x"]).withColumnRenamed("lang", "kept")
    with pytest.raises(ValueError):
        quality.compression_bands(docs, keep=["doc_id", "kept"])
    assert quality.compression_bands(docs).count() == 1


def test_torn_and_null_media_keep_their_rows(spark):
    rows = media.store_as_avi(spark.createDataFrame([(1, "abc " * 200), (2, "x")], "doc_id long, text string")).collect()
    broken = [(3, 1, None), (4, 1, bytearray(b"")), (5, 1, bytearray(rows[0].media[: len(rows[0].media) // 2])), (6, 1, bytearray(b"RIFFnoise"))]
    movies = spark.createDataFrame([tuple(r) for r in rows] + broken, "doc_id long, n_bytes long, media binary").coalesce(1)
    got = {r.doc_id: r for r in media.media_digests(movies).collect()}
    assert got[1].error is None and got[1].payload_bytes == 832 and got[2].payload_bytes == 64
    assert got[3].error == "no media" and got[3].media_bytes is None
    assert all(got[i].error and got[i].payload_sha256 is None and got[i].feature is None for i in (4, 5, 6))
    assert {r.doc_id for r in media.clips(movies.select("doc_id", "media")).collect()} <= {1, 2}


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(k).count("1") % 2 else a for k in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_and_lines_of_equal_polynomial_hashes(spark, n):
    one, other = thue_morse(n), thue_morse(n, "b", "a")
    docs = spark.createDataFrame([(1, f"{one}\n{other}\n{one}"), (2, other), (3, one)], "doc_id long, text string")
    counts = {r.doc_id: r.n_dup_lines for r in quality.compression_bands(docs).collect()}
    assert counts == {1: 1, 2: 0, 3: 0}
    library = Tokenizer.from_file(catalog.TOKENIZER)
    want = {d: library.encode(t, add_special_tokens=False).ids for d, t in docs.collect()}
    assert {r.doc_id: r.ids for r in bpe_codec.encode_ids(docs, catalog.TOKENIZER).collect()} == want


def test_texts_beyond_a_chunk(spark):
    rng = np.random.default_rng(3)
    text = " ".join(f"w{k}" for k in rng.integers(0, 5000, 250_000))
    assert len(text) > kernels.CHUNK_BYTES
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    row = {r.doc_id: r for r in quality.compression_bands(docs).collect()}
    assert row[1].n_words == 250_000 and row[1].n_chunks == -(-len(text) // quality.CHUNK) and row[2].base_failed
    library = Tokenizer.from_file(catalog.TOKENIZER)
    got = {r.doc_id: r.n_tokens for r in bpe_codec.encode_decode(docs, catalog.TOKENIZER).collect()}
    assert got == {1: len(library.encode(text, add_special_tokens=False).ids), 2: 0}
    assert [r.score for r in toxicity.score(docs, toxicity.train(["a b"], [0], 0.1)).collect()] == [0.1, 0.1]
