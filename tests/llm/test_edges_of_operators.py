"""Every operator on nulls, a text beyond a chunk, repeats, columns of clashing names, and on nothing."""

import hashlib

import pytest
from pyspark.sql import functions as F

from edgewright.llm import bpe_codec, catalog, licences, lines, media, mixing, phrases, rollup, sharding, token_io
from edgewright.llm import kernels as K

LONG = "Under the MIT license. word " * 60_000
ROWS = [(1, LONG, "en", "a"), (2, None, None, None), (3, "", "en", "a"), (None, "no id, under the mit license", "de", "b"), (5, "two rows\nof it", "fr", "c"), (5, "two rows\nof it", "fr", "c")]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASHING = "n_words size hash key part place ids start rank total bucket shard slot copies target media n_bytes keep line n_lines cell n counts words word f k1 k2 list u expected certain more score labels".split()

OPERATORS = {
    "licences": lambda d: licences.scan_licenses(d),
    "token_io": lambda d: token_io.token_file_digest(d, catalog.TOKENIZER),
    "mixing": lambda d: mixing.copies(*mixing.pareto_mix(d)).select("doc_id", "size", "copies"),
    "bpe": lambda d: bpe_codec.encode_decode(d, catalog.TOKENIZER),
    "sharding": lambda d: sharding.stratified_shards(d, shards=3),
    "media": lambda d: media.media_digests(media.store_as_avi(d)),
    "counts": lambda d: d.select("doc_id", *(rollup.token_count(F.col("text"), t).alias(f"t{k}") for k, t in enumerate(catalog.COUNTED.values()))),
    "lines": lambda d: lines.kept_digests(d),
    "phrases": lambda d: phrases.collocations(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_names_change_nothing_and_nothing_gives_nothing(spark, name):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    more = docs.withColumns({c: F.lit(f"x{k}") for k, c in enumerate(CLASHING)})
    plain, got = ([tuple(map(str, r)) for r in OPERATORS[name](d).collect()] for d in (docs, more))
    assert sorted(plain) == sorted(got) and len(got) == (len(ROWS) if name != "phrases" else len(got)) and got
    assert OPERATORS[name](docs.limit(0)).count() == 0


def test_texts_beyond_a_chunk_are_whole(spark):
    assert len(LONG) > K.CHUNK_BYTES
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(catalog.TOKENIZER).encode(LONG, add_special_tokens=False).ids
    docs = spark.createDataFrame(ROWS[:1], SCHEMA)
    one = OPERATORS["licences"](docs).first()
    assert (one["n_words"], one["n_base"], one["first_word"], one["last_word"]) == (300_000, 60_000, 0, 299_995)
    assert OPERATORS["token_io"](docs).first()["n_tokens"] == len(ids) + 1
    assert OPERATORS["bpe"](docs).first()["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert OPERATORS["counts"](docs).first()["t0"] == len(ids)
    payload = LONG.encode() + bytes(-len(LONG) % 64)
    assert OPERATORS["media"](docs).first()["payload_sha256"] == hashlib.sha256(payload).hexdigest()
    assert OPERATORS["sharding"](docs).first()["size"] == len(LONG) + 16
