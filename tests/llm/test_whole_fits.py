"""Bands are fitted to every good row, and what workers hold is bounded."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from edgewright.llm import bpe, catalog, kernels, quality, toxicity


def test_bands_are_those_of_all_good_rows(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [" ".join("".join(rng.choices(letters[: rng.randint(2, 26)], k=rng.randint(2, 9))) for _ in range(55)) for _ in range(5600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, 1) for i in range(len(texts))], "doc_id long, quality int")
    got = quality.fit_bands(docs, labels)
    pieces = quality._pieces(pa.array(texts)).flatten()
    sizes, ratios = pieces.field("size").to_numpy(), pieces.field("ratio").to_numpy().round(quality.RATIO_DIGITS)
    assert len(sizes) > 5000
    steps = np.floor(np.log2(sizes) * quality.STEPS)
    for at, low, high in zip(*got, strict=True):
        own = ratios[steps == at * quality.STEPS - 0.5]
        lo, mid, hi = np.quantile(own, [quality.TAIL, 0.5, 1 - quality.TAIL])
        assert np.allclose([low, high], [lo - quality.MARGIN * (mid - lo), hi + quality.MARGIN * (hi - mid)], atol=1e-9)


def test_scores_do_not_hold_all_grams():
    rng = random.Random(4)
    text = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(100_000))
    model = toxicity.Model(np.ones(toxicity.BUCKETS, np.float32), 1.0, 1.0, 0.0, 0.0)
    buf, offs = kernels.texts(pa.array([text]))
    tracemalloc.start()
    assert toxicity.logits(buf, offs, model).tolist() == [2.0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20


def test_scoring_drops_the_encoder_of_an_earlier_stage():
    bpe.encoder(catalog.TOKENIZER, True)
    toxicity._scores(pa.array(["a b"]), toxicity.Model(np.zeros(toxicity.BUCKETS, np.float32), 0.0, 0.0, 0.0, 0.0))
    assert not bpe._encoders
