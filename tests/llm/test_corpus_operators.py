"""Operators on whole tables, held against brute force."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from edgewright.llm import catalog, mixing, near, rollup, sharding
from edgewright.llm import kernels as K

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, size):
    words = re.findall(rb"[^\x20\x09-\x0d]+", bytes(b + 32 if 65 <= b < 91 else b for b in (text or "").encode()))
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1))


def brute_components(rows, size, p, q):
    sets, parent, lists = [shingles(t, size) for _, t in rows], list(range(len(rows))), {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in lists.get(x, ()))
        for j, k in shared.items():
            if q * k >= p * (len(s) + len(sets[j]) - k):
                parent[root(j)] = root(i)
        for x in s:
            lists.setdefault(x, []).append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


def near_rows():
    rng, rows = random.Random(5), []
    base, passage = [f"w{rng.randint(0, 999)}" for _ in range(150)], [f"p{i}" for i in range(60)]
    for i in range(300):
        words = [f"w{rng.randint(0, 999)}" for _ in range(rng.randint(0, 120))]
        if i % 5 == 0:
            words = base[:]
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = f"e{rng.randint(0, 10**6)}"
        elif i % 5 == 2:
            words = passage + [f"q{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 12))]
        elif i % 5 == 3:
            words = base[rng.randint(0, 9) : 150 - rng.randint(0, 9)]
        elif i % 5 == 4:
            words = [rng.choice("aB") for _ in range(rng.randint(0, 12))]
        rows.append((i, " ".join(words) if i % 50 else None))
    return rows + rows[:20]


@pytest.mark.parametrize(("size", "p", "q", "long"), [(3, 9, 10, 8), (5, 4, 5, 64)])
def test_jaccard_components(spark, monkeypatch, size, p, q, long):
    monkeypatch.setattr(near, "LONG_LIST", long)
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, near.jaccard_components(docs, size, p, q).collect())) == brute_components(rows, size, p, q)


def test_every_link(spark):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found, links = near.class_links(docs, 3, 9, 10)
    key = {r.doc_id: r.fp for r in found.collect() if r.n}
    sets = {key[d]: shingles(t, 3) for d, t in rows if d in key}
    want = {(a, b) for a in sets for b in sets if a < b and 19 * len(sets[a] & sets[b]) >= 9 * (len(sets[a]) + len(sets[b]))}
    assert sorted(map(tuple, links.collect())) == sorted(want)


def test_jaccard_of_nothing(spark):
    assert near.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_probed_overlaps():
    import numpy as np

    rng = random.Random(4)
    for _ in range(200):
        query = np.array(sorted(rng.sample(range(60), rng.randint(0, 40))), np.uint64)
        sets = [np.array(sorted(rng.sample(range(60), rng.randint(0, 40))), np.uint64) for _ in range(rng.randint(1, 12))]
        offs = np.cumsum([0, *map(len, sets)])
        assert near.overlaps(query, np.concatenate(sets), offs).tolist() == [len(np.intersect1d(query, x)) for x in sets]


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(k).count("1") % 2 else a for k in range(n))


def test_jaccard_tells_words_of_equal_polynomial_hashes_apart(spark):
    own = " ".join(f"w{k}" for k in range(40))
    rows = [(i, f"{w} {own}") for i, w in enumerate((thue_morse(2048), thue_morse(2048, "b", "a"), thue_morse(2048)))]
    docs = spark.createDataFrame([(i, t[:2050]) for i, t in rows], "doc_id long, text string")
    assert sorted(map(tuple, near.jaccard_components(docs, 3).collect())) == brute_components([(i, t[:2050]) for i, t in rows], 3, 9, 10)


def test_jaccard_of_a_text_beyond_a_chunk_and_null_ids(spark):
    rng = random.Random(2)
    long = " ".join(f"v{rng.randint(0, 10**6)}" for _ in range(160_000))
    assert len(long) > K.CHUNK_BYTES
    rows = [(1, long), (2, long + " tail"), (3, long[: len(long) // 2]), (4, "a b c d e f g h i j k l m")]
    docs = spark.createDataFrame([*rows, (None, long + " more"), (None, "x y z")], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.jaccard_components(docs).collect() if r.doc_id}
    assert {d: c for d, (_, c) in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert got[1][0] == len(shingles(long, 3))


def brute_targets(sizes, weights, share, most):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, done = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in done]
        left, sum_w = total - sum(done.values()), sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / sum_w > most * sizes[s]]
        if not over:
            return done | {s: left * weight[s] / sum_w for s in rest}
        done |= {s: most * sizes[s] for s in over}


def mix_docs(spark):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        source = None if i % 40 == 0 else "hot" if i % 3 == 0 else f"s{i % 7}"
        rows.append((i, None if i % 90 == 0 else " ".join("w" * (i % 4 + 1) for _ in range(rng.randint(0, 300))), "en", source, 0))
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_pareto_mix(spark):
    rows, docs = mix_docs(spark)
    found, choices = mixing.pareto_mix(docs)
    got = {r.doc_id: r for r in mixing.copies(found, choices).collect()}
    sizes = Counter()
    for i, text, _, source, _ in rows:
        sizes[source] += len((text or "").split())
        assert got[i].size == len((text or "").split())
    want = brute_targets(sizes, (5, 2, 1), 1.5, 2.0)
    taken = Counter()
    for i, _, _, source, _ in rows:
        r = got[i]
        assert r.target == pytest.approx(want[source]) and r.source_size == sizes[source] and 0 <= r.copies <= 2
        taken[source] += r.copies * r.size
    for source, target in want.items():
        assert abs(taken[source] - target) <= max(30, 0.01 * target), source
    again = {r.doc_id: r.copies for r in mixing.copies(*mixing.pareto_mix(docs.repartition(5))).collect()}
    assert again == {i: r.copies for i, r in got.items()}
    mixed = Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert mixed == Counter({i: c for i, c in again.items() if c})


def test_repeated_rows_do_not_overshoot_the_target(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.choice((100, 101, 103))), "en", "a", 0) for i in range(60)] + [(99, "one two three four five six seven", "en", "a", 0)] * 200
    docs = spark.createDataFrame(rows, SCHEMA)
    total = sum(len(r[1].split()) for r in rows)
    for seed in range(1, 5):
        got = mixing.copies(*mixing.pareto_mix(docs, seed=seed)).collect()
        assert len({r.copies for r in got if r.doc_id == 99}) == 1
        assert sum(r.copies * r.size for r in got) <= 1.5 * total + 103


def test_stratified_shards(spark):
    rows, docs = mix_docs(spark)
    docs = docs.unionByName(docs.where("doc_id < 20"))
    got = sharding.stratified_shards(docs, shards=7).collect()
    assert len(got) == docs.count()
    slots, source = {}, {i: s for i, _, _, s, _ in rows}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(slots) == list(range(7))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    for s in set(source.values()):
        counts = Counter(r.shard for r in got if source[r.doc_id] == s)
        assert max(counts[k] for k in range(7)) - min(counts[k] for k in range(7)) <= 2
    assert sorted(map(tuple, got)) == sorted(map(tuple, sharding.stratified_shards(docs.repartition(6), shards=7).collect()))


def test_shards_fewer_rows_than_shards(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s", 1), (2, None, None, None, None)], SCHEMA)
    assert sorted(r.size for r in sharding.stratified_shards(docs).collect()) == [16, 17]
    assert sharding.stratified_shards(docs.where("doc_id < 0")).count() == 0


def test_token_rollup(spark, tmp_path):
    total = rollup.TokenRollup(spark, str(tmp_path / "totals"))
    schema = "source string, lang string, tokenizer string, change string, tokens long, old_tokens long, more string"
    assert total.totals().count() == 0 and total.batches() == []
    first = spark.createDataFrame([("a", "en", "t", "insert", 5, None, ""), ("a", "en", "t", "insert", 7, None, ""), (None, "en", "t", "insert", None, None, "")], schema)
    assert total.commit("1", first) and not total.commit("1", first)
    total.commit("2", spark.createDataFrame([("a", "en", "t", "delete", 5, None, ""), ("a", "en", "t", "revise", 9, 7, "")], schema))
    total.commit("none", spark.createDataFrame([], schema))
    want = {("a", "en", "t", 1, 9), (None, "en", "t", 1, 0)}
    assert set(map(tuple, total.totals().collect())) == want
    total.tidy()
    assert set(map(tuple, rollup.TokenRollup(spark, str(tmp_path / "totals")).totals().collect())) == want
    with pytest.raises(Exception, match="unknown change"):
        total.commit("3", spark.createDataFrame([("a", "en", "t", "move", 1, None, "")], schema))
    assert total.batches() == ["1", "2", "none"] and set(map(tuple, total.totals().collect())) == want


def test_tidying_spares_what_is_not_yet_published(spark, tmp_path):
    schema = "source string, lang string, tokenizer string, change string, tokens long, old_tokens long"
    one = spark.createDataFrame([("a", "en", "t", "insert", 5, None)], schema)
    writer, other = (rollup.TokenRollup(spark, str(tmp_path / "totals")) for _ in range(2))
    writer.commit("1", one)
    writer.commit("2", one)
    publish = rollup.TokenRollup._publish

    def between(self, *rest):
        other.tidy()
        publish(self, *rest)

    rollup.TokenRollup._publish = between
    try:
        assert writer.commit("3", one)
    finally:
        rollup.TokenRollup._publish = publish
    assert [tuple(r) for r in other.totals().collect()] == [("a", "en", "t", 3, 15)]
    other.tidy()
    assert len(list((tmp_path / "totals").glob("totals-*"))) == 1 and other.batches() == ["1", "2", "3"]


def test_rollup_query_equals_brute_force(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    byte, piece = Tokenizer.from_file(catalog.TOKENIZER), sentencepiece.SentencePieceProcessor(model_file=catalog.COUNTED["piece-bpe-32k"])
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    want = Counter()
    for r in catalog.documents(spark, sf).collect():
        t0, t1 = len(byte.encode(r.text or "", add_special_tokens=False).ids), len(piece.encode(r.text or ""))
        low, toxic = (r.doc_id in labels and labels[r.doc_id].quality == 0), (r.doc_id in labels and labels[r.doc_id].toxic == 1)
        want[r.source, r.lang, "byte-bpe-50k", "d"] += 0 if low else 1
        want[r.source, r.lang, "byte-bpe-50k", "t"] += 0 if low or toxic else t0
        want[r.source, r.lang, "piece-bpe-32k", "d"] += 1
        want[r.source, r.lang, "piece-bpe-32k", "t"] += t1
    got = Counter()
    for r in catalog.op10_token_rollup(spark, sf).collect():
        got[r.source, r.lang, r.tokenizer, "d"] += r.n_docs
        got[r.source, r.lang, r.tokenizer, "t"] += r.n_tokens
    assert +got == +want


def test_pipeline_stages(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = catalog.documents(spark, "/root/testdata/sf0.001")
    first = corpus_pipeline.quality_rules(spark, docs, "/root/testdata/sf0.001")
    assert first.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in first.collect()]
    stays = corpus_pipeline.near_duplicates(spark, first, "/root/testdata/sf0.001")
    assert stays.columns == docs.columns
    assert sorted(r.doc_id for r in stays.collect()) == sorted({c for _, _, c in brute_components(kept, 5, 4, 5)})
    assert set(rows.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} and rows.count() > 0


def test_rows_of_one_doc_id_in_different_components_stay(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(80)) for x in "abc")
    rows = [(1, a, "s"), (1, b, "s"), (2, b + " more", "s"), (3, c, "s"), (3, c, "t"), (4, a + " more", "s"), (5, "", "s"), (None, a, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, a, "s"), (1, b, "s"), (3, c, "s"), (5, "", "s"), (None, a, "s")], key=str)
