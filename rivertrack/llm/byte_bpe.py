"""Byte-level BPE with a given vocabulary of ranks: encoding, and decoding back to bytes.

Two tiers. A pre-token that is itself in the vocabulary is resolved by a minimal perfect hash
over all tokens: one slot per token, no collisions, and a comparison with the token in the slot
tells strangers apart. Any other pre-token is merged pair by pair, lowest rank first: a heap of
adjacent pairs over a linked list of byte positions, O(n log n) for n bytes.

The vocabulary is read once by the driver and broadcast; its size is that of the file, about one
megabyte, whatever the corpus.
"""

import base64
import heapq
import struct

import numpy as np
import regex
import xxhash

from rivertrack.llm.common import map_batches
from rivertrack.llm.units import LONGEST, Remembered

_MASK = (1 << 64) - 1
_STEP, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


class PerfectHash:
    """Hash and displace: keys fall into buckets of about two; a bucket stores the displacement
    that sends its keys to free slots, and a bucket of one key stores its slot."""

    def __init__(self, keys):
        n = self.n = len(keys)
        self.buckets = max(1, n // 2)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        places = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            places[h % self.buckets].append(i)
        self.key_at = np.full(n, -1, np.int64)
        self.shift = np.zeros(self.buckets, np.int64)
        for b in sorted(range(self.buckets), key=lambda b: -len(places[b])):
            members = places[b]
            if len(members) < 2:
                break
            d = 0
            while True:
                slots = [self._slot(hashes[i], d) for i in members]
                if len(set(slots)) == len(slots) and all(self.key_at[s] < 0 for s in slots):
                    break
                d += 1
            self.shift[b] = d
            self.key_at[slots] = members
        free = iter(np.flatnonzero(self.key_at < 0).tolist())
        for b in range(self.buckets):
            if len(places[b]) == 1:
                slot = next(free)
                self.key_at[slot], self.shift[b] = places[b][0], -slot - 1

    def _slot(self, h, d):
        return (((h + d * _STEP & _MASK) * _MIX & _MASK) >> 20) % self.n

    def slots(self, keys):
        """The slot each key would have if it were one of the keys."""
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
        d = self.shift[h % np.uint64(self.buckets)]
        mixed = (h + d.astype(np.uint64) * np.uint64(_STEP)) * np.uint64(_MIX)
        slot = (mixed >> np.uint64(20)) % np.uint64(self.n)
        return np.where(d < 0, -d - 1, slot.astype(np.int64))


class Vocabulary:
    """Tokens by id, the perfect hash over them, and the pattern that makes pre-tokens."""

    def __init__(self, tokens, pattern):
        self.tokens, self.pattern = tokens, pattern
        self.hash = PerfectHash(tokens)

    @classmethod
    def from_file(cls, path, pattern):
        """A file of lines "base64-token id", the ids from 0 without gaps."""
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        tokens = [b""] * len(pairs)
        for token, rank in pairs:
            tokens[int(rank)] = base64.b64decode(token)
        return cls(tokens, pattern)


def merge(word, rank):
    """Token ids of ``word``: the adjacent pair of lowest rank is joined, the leftmost first.
    ``after`` links each live position to the next; the token at i is word[i:after[i]]. A pair is
    one number, its rank times n plus its position, so that the heap orders by both."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pair, heap = [None] * n, []
    for i in range(n - 1):
        r = rank(word[i : i + 2])
        if r is not None:
            pair[i] = r = r * n + i
            heap.append(r)
    heapq.heapify(heap)
    while heap:
        r = heapq.heappop(heap)
        i = r % n
        if pair[i] != r:
            continue  # one of the two has been joined meanwhile
        j = after[i]
        end = after[i] = after[j]
        pair[i] = pair[j] = None
        if end < n:
            before[end] = i
            r = rank(word[i : after[end]])
            if r is not None:
                pair[i] = r = r * n + i
                heapq.heappush(heap, r)
        p = before[i]
        if p >= 0:
            r = rank(word[p:end])
            if r is not None:
                r = r * n + p
                heapq.heappush(heap, r)
            pair[p] = r
    out, i = [], 0
    while i < n:
        out.append(rank(word[i : after[i]]))
        i = after[i]
    return out


MOST_WORDS = 300_000  # pre-tokens that a worker remembers


class Codec:
    """Encoding and decoding with one vocabulary, in one Python worker."""

    def __init__(self, vocabulary):
        self.tokens, self.hash = vocabulary.tokens, vocabulary.hash
        self.split = regex.compile(vocabulary.pattern).findall
        self.rank = {t: i for i, t in enumerate(self.tokens)}.get
        self.key_at = self.hash.key_at.tolist()
        self.words = {}
        self.encode = Remembered(self._encode)

    def _pretokens(self, words):
        """Pre-token -> bytes of its ids, for the pre-tokens ``words``, and of some others."""
        if len(self.words) + len(words) > MOST_WORDS:
            self.words = {}
        ids = self.words
        words = list(words.difference(ids))
        keys = [w.encode() for w in words]
        for word, key, slot in zip(words, keys, self.hash.slots(keys).tolist(), strict=True):
            token = self.key_at[slot]
            if self.tokens[token] == key:
                ids[word] = token.to_bytes(4, "little")
            else:
                found = merge(key, self.rank)
                ids[word] = struct.pack(f"<{len(found)}I", *found)
        return ids

    def _encode(self, texts):
        split = [self.split(t) for t in texts]
        used = {w for words in split for w in words}
        ids = self._pretokens(used)
        found = [b"".join(map(ids.__getitem__, words)) for words in split]
        for word in used:
            if len(word) > LONGEST:
                del ids[word]  # not worth remembering
        return found

    def decode(self, ids):
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_CODECS = {}


def _codec(shared):
    if shared.id not in _CODECS:
        _CODECS.clear()
        _CODECS[shared.id] = Codec(shared.value)
    return _CODECS[shared.id]


class _Shared:
    """A broadcast vocabulary with a name by which Python workers keep their codec."""

    def __init__(self, spark, vocabulary):
        self.cast = spark.sparkContext.broadcast(vocabulary)
        self.id = xxhash.xxh3_64_hexdigest(
            b"\0".join(vocabulary.tokens) + vocabulary.pattern.encode()
        )

    @property
    def value(self):
        return self.cast.value


def _field(df, name):
    return f"`{name}` {df.schema[name].dataType.simpleString()}"


def encode(docs, vocabulary, id_col="doc_id", text="text"):
    """One row (id, ids array<int>) per row of ``docs``; special tokens are ordinary text.

    A null or empty text has no ids. Rows that repeat are encoded each; other columns are not
    read. A text may be of any length; it is never held twice."""
    shared = _Shared(docs.sparkSession, vocabulary)

    def start():
        codec = _codec(shared)

        def step(keys, texts):
            found = codec.encode(t or "" for t in texts)
            return keys, [np.frombuffer(ids, "<i4") for ids in found]

        return step

    return map_batches(docs.select(id_col, text), f"{_field(docs, id_col)}, ids array<int>", start)


def decode(rows, vocabulary, id_col="doc_id", ids="ids"):
    """One row (id, bytes binary) per row of ids; null ids decode to nothing."""
    shared = _Shared(rows.sparkSession, vocabulary)

    def start():
        codec = _codec(shared)

        def step(keys, lists):
            return keys, [codec.decode(np.array(x or [], np.int64)) for x in lists]

        return step

    return map_batches(rows.select(id_col, ids), f"{_field(rows, id_col)}, bytes binary", start)


def round_trip(docs, vocabulary, id_col="doc_id", text="text"):
    """`encode` and `decode` in one pass: one row (id, ids array<int>, bytes binary) per row."""
    shared = _Shared(docs.sparkSession, vocabulary)

    def start():
        codec = _codec(shared)

        def step(keys, texts):
            ids = [np.frombuffer(x, "<i4") for x in codec.encode(t or "" for t in texts)]
            return keys, ids, [codec.decode(x) for x in ids]

        return step

    schema = f"{_field(docs, id_col)}, ids array<int>, bytes binary"
    return map_batches(docs.select(id_col, text), schema, start)
