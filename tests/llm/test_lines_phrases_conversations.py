"""Conversation repair, line deduplication and collocations, held against brute force."""

import functools
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgewright.llm import conversations, lines, phrases

WHITE = " \t\n\x0b\f\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# ---- conversations


def brute_repair(rows):
    """The results for (conv_id, turn, role, text) rows by search with memory, one conversation at a time."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        part = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        kept = convs[conv]
        if part == 1:
            text = ""
        elif part == 2:
            text = re.sub("[.!?]", "", text)
        elif part == 4:
            role = "user"
        if part != 0:
            kept += [(turn, role, text)] * (2 if part == 3 else 1)
    out = {}
    for conv, kept in convs.items():
        digest = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, faults = set(), []
        for _, role, text in kept:
            bare = text.strip(WHITE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [role[:1] for _, role, _ in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))

        @functools.cache
        def best(t, so_far, inserted):
            found = []
            if t == len(kept) and re.fullmatch("(s?(ua)+)?", so_far):
                found.append((0, "", ()))
            if inserted < 3:
                for role in "ua":
                    if fits(so_far + role):
                        c, audit, turns = best(t, short(so_far + role), inserted + 1)
                        found.append((3 + c, "I" + audit, ({"u": "user", "a": "assistant"}[role] + ":", *turns)))
            if t < len(kept):
                _, role, text = kept[t]
                c, audit, turns = best(t + 1, so_far, 0)
                found.append((4 + c, "D" + audit, turns))
                if faults[t] not in ("blank", "duplicate"):
                    extra = 3 * (faults[t] == "truncated")
                    for letter, name, cost in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                        if fits(so_far + name[:1]) and name[:1]:
                            c, audit, turns = best(t + 1, short(so_far + name[:1]), 0)
                            found.append((cost + extra + c, letter + audit, (f"{name}:{text}", *turns)))
            return min(found, default=(10**9, "", ()))

        cost, audit, turns = best(0, "", 0)
        count = Counter(faults)
        sha = hashlib.sha256("\n".join(turns).encode()).hexdigest()
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha)
    return out


def fits(roles):
    return re.fullmatch("s?(ua)*u?", roles) is not None


def short(roles):
    """Roles of the same state: of pairs one is enough."""
    return re.sub("^s?(ua)+", "ua", roles)


def conversation_rows():
    rng, rows = random.Random(3), []
    for conv in [*range(70), None]:
        for turn in range(rng.randint(1, 14)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "cut off", "", " \n", None, "Well? ", f"t{turn}."])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), role, text))
    return rows + rows[:9]


@pytest.mark.parametrize("rows_together", [conversations.ROWS, 5])
def test_repair_equals_search(spark, rows_together, monkeypatch):
    rows = conversation_rows()
    monkeypatch.setattr(conversations, "ROWS", rows_together)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"gone": F.lit(True), "digest": F.lit("x"), "kind": F.lit(1), "audit": F.lit("?")})
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.repair_digests(table.repartition(3)).collect()}
    want = brute_repair(rows)
    assert got.keys() == want.keys()
    for conv in want:
        assert got[conv] == want[conv], conv


def test_repaired_turns_fit_and_long_conversations(spark):
    rows = [(1, t, "user" if t % 3 else "assistant", f"row {t}.") for t in range(5000)] + [(2, 0, "user", "Hi.")]
    made = conversations.damaged(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    audited = conversations.audits(made)
    turns = conversations.repaired(made, audited).where("conv_id = 1").orderBy("place").collect()
    assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in turns))
    assert [r["place"] for r in turns] == list(range(len(turns)))
    audit = audited.where("conv_id = 1").head()["audit"]
    assert "".join(r["edit"] for r in turns) == audit.replace("D", "")


def test_repair_of_nothing(spark):
    assert conversations.repair_digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# ---- lines


def brute_lines(rows):
    key = lambda x: lower(x.strip(WHITE))
    held, nulls = defaultdict(set), defaultdict(bool)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is None:
                nulls[key(line)] = True
            else:
                held[key(line)].add(doc)
    out = []
    for doc, text in rows:
        kept, n = [], 0
        for line in (text or "").split("\n"):
            n += 1
            k = key(line)
            docs = held[k]
            other = len(docs) + nulls[k] > 1 and len(k) >= 10
            if not (other and (doc is None or doc != min(docs))):
                kept.append(line)
        out.append((doc, n, n - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def line_rows():
    rng, rows = random.Random(4), []
    stock = [f"A line of stock {k} é" for k in range(30)] + ["", "short", "  ", "ten chars.", "\tTEN CHARS.\r", "nine char", "ÄÄÄÄÄÄÄÄÄÄ", "ääääääääää"]
    for doc in range(120):
        text = "\n".join(rng.choice(stock) if rng.random() < 0.6 else f"own line {doc} {rng.random()}" for _ in range(rng.randint(0, 15)))
        rows.append((doc * 3 % 121, "A COMMON line\n" * 3 + text if doc % 3 else text))
    rows += [(None, "A line of stock 1 é\nonly nulls hold this"), (None, "only nulls hold this"), (5, None), (7, ""), (7, "A line of stock 2 é"), (9, "x" * 300_000 + "\n" + "A line of stock 3 é\n" * 2000)]
    return rows + rows[:10]


@pytest.mark.parametrize("parts", ["1", "4", "40"])
def test_lines_equal_brute_force_however_ranges_fall(spark, parts):
    rows = line_rows()
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"hash": F.lit("x"), "line": F.lit(1), "text_key": F.lit(2), "keep": F.lit(3), "known": F.lit(4)})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = sorted((tuple(r) for r in lines.kept_digests(table).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert got == brute_lines(rows)


def test_bitmaps_of_text_ids_and_of_nothing(spark):
    rows = [("b", "one common line\nx"), ("a", "one common line"), ("c", "y\nONE common line ")]
    got = {r["doc_id"]: r for r in lines.keep_bitmaps(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert [got[d]["n_dropped"] for d in "abc"] == [0, 1, 1] and got["a"]["keep"] is None
    assert np.unpackbits(np.frombuffer(zlib.decompress(got["c"]["keep"]), np.uint8), count=2).tolist() == [1, 0]
    assert lines.kept_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- phrases


def brute_phrases(rows, longest=3, least=10, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\f\r]", lower(text or "")):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for n in range(1, longest + 1):
                counts[lang].update(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
    out = []
    for lang, of in counts.items():
        often = {p: a for p, a in of.items() if a >= least and len(p) > 1}
        within = lambda p, q: any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1))
        rows = []
        for p, a in often.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and within(p, q) for q, b in often.items()):
                continue
            score, k = min((1000000 * a * a // (of[p[:k]] * of[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), of[p[:k]], of[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def phrase_rows(languages=("en", "de", None, "und")):
    rng, rows = random.Random(6), []
    for k in range(150):
        words = [rng.choice(["the", "of", "A", "é", "x-y", "…", f"w{rng.randint(0, 40)}"]) for _ in range(rng.randint(0, 60))]
        words = [w + rng.choice(["", "", "", "", ",", ".", "\n", ";;", "\t"]) for w in words]
        rows.append((rng.choice(languages), " ".join(words) + rng.choice(["", " New York City", " New York City New York", " a a a a a"]) * rng.randint(0, 3)))
    return rows + [("en", None), ("fr", ""), (None, None), ("en", "the of " * 9000 + "z" * 5000)] + rows[:5]


@pytest.mark.parametrize(("shard", "longest"), [(phrases.SHARD_BYTES, 3), (300, 3), (4000, 5)])
def test_phrases_equal_brute_force(spark, shard, longest, monkeypatch):
    rows = phrase_rows()
    monkeypatch.setattr(phrases, "SHARD_BYTES", shard)
    table = spark.createDataFrame(rows, "lang string, text string").withColumns({"key": F.lit(1), "n": F.lit(2), "word": F.lit(3), "cell": F.lit(4)})
    got = sorted(tuple(r) for r in phrases.collocations(table.repartition(3), longest, top=50).collect())
    want = brute_phrases(rows, longest, top=50)
    assert got == want and len(got) > 40


def test_intervals_count_overlaps_and_stop_at_pieces():
    ids, piece = np.array([7, 7, 7, 3, 7, 7], dtype=np.uint64), np.array([0, 0, 0, 0, 1, 1])
    got = {(n, tuple(ids[p : p + n].tolist())): c for n, places, counts in phrases.suffix_intervals(ids, piece, 3) for p, c in zip(places.tolist(), counts.tolist())}
    assert got == {(1, (7,)): 5, (1, (3,)): 1, (2, (7, 7)): 3, (2, (7, 3)): 1, (3, (7, 7, 7)): 1, (3, (7, 7, 3)): 1}


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3_000_000_019
    rows = [("en", 0, [], 3 * big, None), ("en", 1, [1], big + 1, "a"), ("en", 1, [2], big + 2, "b"), ("en", 2, [1, 2], big, None)]
    counts = spark.createDataFrame(rows, "lang string, n int, key array<bigint>, f long, word string")
    before, phrases.phrase_counts = phrases.phrase_counts, lambda *_: counts
    try:
        got = phrases.collocations(counts).head()
    finally:
        phrases.phrase_counts = before
    assert got["score"] == 1000000 * big * big // ((big + 1) * (big + 2)) and got["phrase"] == "a b"


def test_phrases_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


# ---- toxicity: the score of a given model


def test_toxicity_score_equals_the_bags_by_hand(spark):
    from edgewright.llm import kernels as K
    from edgewright.llm import toxicity

    rng = np.random.default_rng(8)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS).astype(np.float32), 0.7, 0.4, -0.2, 0.3)
    one = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & one
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & one
        return x ^ (x >> 31)

    def word_score(word):
        raw = np.frombuffer(word, np.uint8)
        found = [int(K.Spans(raw, K.FIXED_KEY).hash(np.array([0]), np.array([len(raw)]))[0])]
        add = lambda piece, kind: found.append((int.from_bytes(piece, "little") + kind * 0x9E3779B97F4A7C15) & one)
        for n in range(3, 7):
            for k in range(len(word) - n + 1):
                add(word[k : k + n], n)
        for n in range(2, 9):
            if len(word) >= n:
                add(word[:n], 16 + n)
                add(word[-n:], 32 + n)
        return float(np.mean([model.buckets[mix(x) % toxicity.BUCKETS] for x in found]))

    def by_hand(text):
        words = re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text or "").encode())
        if not words:
            return 1 / (1 + np.exp(-model.empty))
        s = [word_score(w) for w in words]
        high = max([(a + b) / 2 for a, b in zip(s, s[1:])] or s)
        return 1 / (1 + np.exp(-(model.mean * np.mean(s) + model.slope * high + model.offset)))

    texts = ["You are BAD", "a", "", None, "--", "straße Ünïcode x1y2", "the same the same word", "w" * 90 + " long", "one two three four five six seven " * 5]
    rows = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    got = {r["doc_id"]: r for r in toxicity.score(rows, model).collect()}
    for k, t in enumerate(texts):
        assert abs(got[k]["score"] - by_hand(t)) < 2e-6 and got[k]["predicted"] == int(by_hand(t) >= 0.5), t
    assert toxicity.score(rows.limit(0), model).count() == 0
