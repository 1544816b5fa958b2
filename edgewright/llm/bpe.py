"""Byte-level BPE: vectorised splitting into words, word caches, and a prefix-sharing trie encoder."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from tokenizers import Tokenizer

from edgewright.llm import kernels as K

LETTER, NUMBER, SPACE, OTHER, UNKNOWN = range(5)
#: Distinct words a worker remembers before it starts anew.
CACHE_WORDS = 200_000


class Splitter:
    """Splits texts as the byte-level pre-tokenizer of the tokenizers library does, many texts at once.

    A character's class (letter, number, white space, other) is asked from the library itself, once for
    each character that occurs, so both agree whatever Unicode version the library holds.
    """

    def __init__(self, tokenizer: Tokenizer):
        self._ask = tokenizer.pre_tokenizer.pre_tokenize_str
        self._kind = np.full(0x110000, UNKNOWN, dtype=np.uint8)
        for c in range(128):
            self._kind[c] = self._probe(chr(c))

    def _probe(self, c: str) -> int:
        for kind, before in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
            if len(self._ask(before + c)) == 1:
                return kind
        return SPACE

    def _kinds(self, buf: np.ndarray, lead: np.ndarray) -> np.ndarray:
        head = buf[lead]
        kinds = self._kind[head & 0x7F]
        wide = np.flatnonzero(head >= 0xC0)
        if len(wide):
            b = [buf[np.minimum(lead[wide] + k, len(buf) - 1)].astype(np.int32) & 0x3F for k in range(4)]
            h = head[wide]
            two, three = ((h & 0x1F).astype(np.int32) << 6) | b[1], ((h & 0x0F).astype(np.int32) << 12) | (b[1] << 6) | b[2]
            four = ((h & 0x07).astype(np.int32) << 18) | (b[1] << 12) | (b[2] << 6) | b[3]
            code = np.where(h < 0xE0, two, np.where(h < 0xF0, three, four))
            for c in np.unique(code[self._kind[code] == UNKNOWN]).tolist():
                self._kind[c] = self._probe(chr(c))
            kinds[wide] = self._kind[code]
        return kinds

    def __call__(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte places where words start, and the n + 1 places among them where each text's words begin."""
        if not len(buf):
            return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
        lead = np.flatnonzero((buf & 0xC0) != 0x80)
        kind, space = self._kinds(buf, lead), buf[lead] == 32
        n = len(lead)
        opens = np.zeros(n + 4, dtype=bool)  # of texts
        opens[np.searchsorted(lead, K.at(offs, len(buf)))] = True
        start = opens.copy()
        start[1:n] |= kind[1:] != kind[:-1]
        # A run after white space: the last white space character leaves its run, and a plain space joins what follows.
        after = np.flatnonzero(start[1:n] & (kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~opens[1:n]) + 1
        start[after - 1] = True
        start[after] = ~space[after - 1]
        self._contractions(buf, lead, kind, space, opens, start)
        starts = lead[np.flatnonzero(start[:n])]
        return starts, np.searchsorted(starts, offs)

    def _contractions(self, buf, lead, kind, space, opens, start) -> None:
        """'s 't 'm 'd 're 've 'll at the start of a word are words of their own."""
        n = len(lead)
        mark = np.flatnonzero(buf[lead] == 39)
        mark = mark[(mark + 1 < n) & start[mark]]
        for i in mark.tolist():
            tail = [chr(buf[lead[i + k]]) if i + k < n and not any(opens[i + 1 : i + k + 1]) else "" for k in (1, 2)]
            size = 2 if tail[0] and tail[0] in "stmd" else 3 if "".join(tail) in ("re", "ve", "ll") else 0
            if size and not (i and space[i - 1] and not opens[i]):
                start[i + 1 : i + size] = opens[i + 1 : i + size]
                if i + size < n:
                    start[i + size] = True


class Vocabulary:
    """Ids, bytes and merges of a byte-level BPE file. Single bytes come first, then tokens in merge order."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letter = {b: chr(b) for b in shown}
        self.letter |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in self.letter)}
        byte = {c: b for b, c in self.letter.items()}
        self.to_letters = str.maketrans({chr(b): c for b, c in self.letter.items()})
        self.ids = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items()}
        self.bytes = {i: token for token, i in self.ids.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right = (self.ids[bytes(byte[c] for c in x)] for x in (a, b))
            whole = self.ids[self.bytes[left] + self.bytes[right]]
            self.merged[left, right] = rank
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = (left, right), rank
        self.longest = max(map(len, self.ids))


class Trie:
    """Encodes distinct words by one depth-first walk of their prefix trie.

    State of a node: the last token of its prefix's encoding. It is the longest token t that ends the prefix
    and may follow the state of the node before t. A word's ids are read back along these states, so
    words that share a prefix share its states. The walk takes words in byte order, which visits the trie's
    nodes depth first; only the path to the present node is held.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._fits: dict[int, bool] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._alone: dict[int, bool] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """(token, rank of the merge that takes it in) along one edge of a token's merge tree, the whole token first."""
        memo = self._right if side else self._left
        if token not in memo:
            spine, until, now = [], float("inf"), token
            while True:
                spine.append((now, until))
                if now not in self.v.parts:
                    break
                until, now = self.v.rank[now], self.v.parts[now][side]
            memo[token] = spine
        return memo[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether the text of a and b is encoded as just a and b: no merge crosses while both edges grow.

        A crossing merge of x and y happens if both exist when its rank comes: before x or y is taken into
        a larger token. Of equal ranks the left place goes first.
        """
        key = a << 32 | b
        known = self._fits.get(key)
        if known is not None:
            return known
        right, left, merged = self._spine(a, 1), self._spine(b, 0), self.v.merged
        i = j = 0
        good = True
        while True:
            (x, x_until), (y, y_until) = right[i], left[j]
            m = merged.get((x, y))
            if m is not None and m < x_until and m <= y_until:
                good = False
                break
            # one step back in time: undo the later of the two merges
            x_made = self.v.rank.get(x, -1)
            y_made = self.v.rank.get(y, -1)
            if x_made < 0 and y_made < 0:
                break
            if x_made > y_made or (x_made == y_made and x_made >= 0):
                i += 1
            else:
                j += 1
        self._fits[key] = good
        return good

    def whole(self, token: int) -> bool:
        """Whether a token's own text is encoded as that token: its two parts come next to each other and stay apart till its merge."""
        known = self._alone.get(token)
        if known is None:
            parts = self.v.parts.get(token)
            known = len(self.v.bytes[token]) == 1 if parts is None else self._joins(*parts, self.v.rank[token])
            self._alone[token] = known
        return known

    def _joins(self, a: int, b: int, rank: int) -> bool:
        if not (self.whole(a) and self.whole(b)):
            return False
        right, left = self._spine(a, 1), self._spine(b, 0)
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = right[i], left[j]
            if (i or j) and (m := self.v.merged.get((x, y))) is not None and m < x_until and m <= y_until and m < rank:
                return False
            x_made, y_made = self.v.rank.get(x, -1), self.v.rank.get(y, -1)
            if x_made < 0 and y_made < 0:
                return max(self.v.rank.get(a, -1), self.v.rank.get(b, -1)) < rank
            if x_made >= y_made:
                i += 1
            else:
                j += 1

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each distinct word, in the order given."""
        out: list[list[int]] = [[]] * len(words)
        ids, longest, fits = self.v.ids, self.v.longest, self._fits
        last: list[int] = []  # of the prefixes of the present path, by depth
        length: list[int] = []
        before = b""
        for at in sorted(range(len(words)), key=words.__getitem__):
            word = words[at]
            depth, most = 0, min(len(before), len(word))
            while depth < most and before[depth] == word[depth]:
                depth += 1
            del last[depth:], length[depth:]
            for end in range(depth + 1, len(word) + 1):
                for begin in range(max(0, end - longest), end):
                    token = ids.get(word[begin:end])
                    if token is None:
                        continue
                    if begin:
                        prior = last[begin - 1]
                        good = fits.get(prior << 32 | token)
                        if good is None:
                            good = self.whole(token) and self.fits(prior, token)
                            fits[prior << 32 | token] = good
                    else:
                        good = self.whole(token)
                    if good:
                        last.append(token)
                        length.append(end - begin)
                        break
            before, found, end = word, [], len(word)
            while end:
                found.append(last[end - 1])
                end -= length[end - 1]
            found.reverse()
            out[at] = found
        return out


def by_library(tokenizer: Tokenizer, vocabulary: Vocabulary) -> Callable[[list[bytes]], list[list[int]]]:
    """An encoder of distinct words by the tokenizers library's own BPE model."""
    model, table = tokenizer.model, vocabulary.to_letters
    return lambda words: [[t.id for t in model.tokenize(w.decode("latin-1").translate(table))] for w in words]


class WordCache:
    """Ids of the words of whole batches, each distinct word encoded once; starts anew past CACHE_WORDS words."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], derive: Callable[[bytes, list[int]], tuple] | None = None):
        self._encode, self._derive = encode, derive
        self.clear()

    def clear(self) -> None:
        self._slot: dict[int, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.derived: list[np.ndarray] = []

    def slots(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each word's place in ``starts`` and ``lengths``; valid until the next call."""
        if len(self._slot) > CACHE_WORDS:
            self.clear()
        hashes, first, which = np.unique(K.Spans(buf).hash(starts, ends), return_index=True, return_inverse=True)
        slot = self._slot
        places = np.fromiter((slot.get(h, -1) for h in hashes.tolist()), np.int64, len(hashes))
        new = np.flatnonzero(places < 0)
        if len(new):
            raw = buf.tobytes()
            words = [raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            ids = self._encode(words)
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            added = np.fromiter((i for x in ids for i in x), np.int32, int(lengths.sum()))
            base = len(self.starts)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.flat = np.concatenate([self.flat, added])
            if self._derive:
                made = list(zip(*map(self._derive, words, ids), strict=True))
                columns = [np.array([*x, None], dtype=object)[:-1] for x in made]
                self.derived = [np.concatenate([a, b]) for a, b in zip(self.derived, columns, strict=True)] if self.derived else columns
            places[new] = np.arange(base, base + len(new))
            slot.update(zip(hashes[new].tolist(), places[new].tolist(), strict=True))
        return places[which]


class Encoder:
    """Encodes many whole texts at once; the special token's string becomes its own id, as the library has it by default."""

    def __init__(self, path: str, trie: bool, derive: Callable[[Vocabulary], Callable[[bytes, list[int]], tuple]] | None = None):
        tokenizer = Tokenizer.from_file(path)
        self.vocabulary = Vocabulary(path)
        self.special = {t.content.encode(): i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.vocabulary.bytes |= {i: s for s, i in self.special.items()}
        ordinary = Trie(self.vocabulary).encode if trie else by_library(tokenizer, self.vocabulary)

        def encode(words: list[bytes]) -> list[list[int]]:
            plain = iter(ordinary([w for w in words if w not in self.special]))
            return [[self.special[w]] if w in self.special else next(plain) for w in words]

        self.cache = WordCache(encode, derive(self.vocabulary) if derive else None)
        self._split = Splitter(tokenizer)

    def _pieces(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word starts and each text's first word; special strings are words of their own."""
        raw, cuts = None, []
        for s in self.special:
            raw = raw or buf.tobytes()
            at = raw.find(s)
            while at >= 0:
                if np.searchsorted(offs, at, "right") == np.searchsorted(offs, at + len(s) - 1, "right"):
                    cuts.append((at, at + len(s)))
                    at = raw.find(s, at + len(s))
                else:  # across two texts
                    at = raw.find(s, at + 1)
        if not cuts:
            return self._split(buf, offs)
        inner = np.union1d(offs, np.array(cuts).ravel())
        starts, _ = self._split(buf, inner)
        begin, end = np.array(sorted(cuts)).T
        nearest = np.searchsorted(begin, starts, "right") - 1
        starts = starts[(nearest < 0) | (starts >= end[nearest]) | (starts == begin[nearest])]
        return starts, np.searchsorted(starts, offs)

    def __call__(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of all words in ``cache``, and the n + 1 places where each text's words begin."""
        starts, first = self._pieces(buf, offs)
        return self.cache.slots(buf, starts, np.append(starts[1:], len(buf))), first

    def ids(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the n + 1 places where each text's ids begin."""
        slots, first = self(buf, offs)
        lengths = self.cache.lengths[slots]
        begins = np.concatenate([[0], np.cumsum(lengths)])[first]
        return K.ragged(self.cache.flat, self.cache.starts[slots], lengths), begins


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, trie: bool, derive=None) -> Encoder:
    """A worker's encoder, made once and kept with its cache."""
    key = (path, trie, derive)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(path, trie, derive)
    return _encoders[key]


def forget() -> None:
    """Drop the encoder that an earlier stage left in this worker, before a stage that needs the memory."""
    if _encoders:
        _encoders.clear()
        K.give_back()
