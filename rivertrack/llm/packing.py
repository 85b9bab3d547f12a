"""Harmonic packing of token ids into sequences, on every worker by itself.

Lengths fall into classes by reciprocal capacity: class k holds pieces of more than C/(k+1) and at
most C/k ids, and a bin of class k is full with k of them. No bin is ever searched for. As
documents may be cut, what is left of one after its whole sequences is cut at the largest class
bound C/k that fits, again and again, so that bins of large classes are all but exactly full;
only an end shorter than ``least`` ids stays as it is, where k is large and little can be lost.
When a worker has no more documents, the pieces in its open bins are laid end to end and cut into
sequences whose lengths are powers of two, which need no padding.

No row leaves its partition and nothing is sorted. What a worker holds is bounded by one open bin
per class. Bins depend on the order of rows in a partition, which for files is the same each time
a task runs; give it a written table, not the unordered result of a shuffle.
"""

import contextlib

import numpy as np
from pyspark import TaskContext

from rivertrack.llm.common import map_batches

CAPACITY = 2048
LEAST = 64
END_ID = 1
PIECES = (
    "{id}, start bigint, length bigint, ids binary, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)


def cut_lengths(n, capacity=CAPACITY, least=LEAST):
    """Lengths of the pieces of ``n`` ids, in order."""
    whole, rest = divmod(n, capacity)
    out = [capacity] * whole
    while rest >= least:
        out.append(capacity // -(-capacity // rest))
        rest -= out[-1]
    return out + [rest] * (rest > 0)


class HarmonicBins:
    """Open bins of one worker. Pieces are (key, start, ids, doc_tokens)."""

    def __init__(self, first_id, capacity=CAPACITY):
        self.capacity, self.next_id, self.bins, self.out = capacity, first_id, {}, []

    def _close(self, pieces):
        offset = 0
        for key, start, ids, total in pieces:
            self.out.append((key, start, len(ids), ids.tobytes(), total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def add(self, piece):
        k = self.capacity // len(piece[2])
        pieces = self.bins.setdefault(k, [])
        pieces.append(piece)
        if len(pieces) == k:
            self._close(self.bins.pop(k))

    def flush(self):
        """Close the open bins: one stream of pieces, cut at powers of two."""
        left = [p for k in sorted(self.bins) for p in self.bins[k]]
        self.bins = {}
        room = sum(len(p[2]) for p in left)
        sizes = [self.capacity] * (room // self.capacity)
        room %= self.capacity
        sizes += [1 << b for b in range(room.bit_length() - 1, -1, -1) if room >> b & 1]
        left.reverse()
        for size in sizes:
            pieces = []
            while size:
                key, start, ids, total = left.pop()
                pieces.append((key, start, ids[:size], total))
                if len(ids) > size:
                    left.append((key, start + size, ids[size:], total))
                size -= len(pieces[-1][2])
            self._close(pieces)

    def taken(self):
        out, self.out = self.out, []
        return list(zip(*out, strict=True))


# the pre-tokens of a byte-level tokenizer that brings no pattern of its own
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONGEST = 1000  # characters without a space, or spaces, beyond which a text is encoded the slow way


def _bytes_of_characters():
    """Byte-level vocabularies write each byte as a character: itself if it can be seen, else the
    next one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    unseen = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + n): b for n, b in enumerate(unseen)}


class Encoder:
    """The ids that the tokenizer of a file gives a text, in two ways.

    Most texts are encoded by the order of merges alone: any two neighbours that make a token are
    joined, earliest merge first. That is what the tokenizer does as well if every token is
    encoded as itself (``plain``): two neighbours make a token of another merge only if their
    text alone would stop at these two, and it does not. Texts with special tokens, and texts
    with very long words, go to the tokenizer itself."""

    def __init__(self, path):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t["content"] for t in said["added_tokens"]]
        vocabulary = said["model"]["vocab"]
        byte_of = _bytes_of_characters()
        merged = [m if isinstance(m, str) else " ".join(m) for m in said["model"]["merges"]]
        order = [*byte_of, *dict.fromkeys(m.replace(" ", "") for m in merged)]
        ranks = {bytes(byte_of[c] for c in token): rank for rank, token in enumerate(order)}
        self.ids = np.array([vocabulary[token] for token in order], "<u4")
        self.order = order
        self.merges = tiktoken.Encoding(
            path, pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={}
        )

    def plain(self):
        """Whether merges by order are the tokenizer's: it is byte-level without more ado, and
        every token that is text is encoded as itself."""
        import json

        said = json.loads(self.tokenizer.to_str())
        how = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        if said["normalizer"] is not None or said["pre_tokenizer"] != how:
            return False
        if said["model"].get("dropout") or said["model"].get("ignore_merges"):
            return False
        byte_of = _bytes_of_characters()
        texts = {}
        for place, token in enumerate(self.order):
            with contextlib.suppress(UnicodeDecodeError):
                texts[bytes(byte_of[c] for c in token).decode()] = int(self.ids[place])
        found = self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)
        return all(x.ids == [i] for x, i in zip(found, texts.values(), strict=True))

    def _ordinary(self, text):
        if any(s in text for s in self.special) or " " * LONGEST in text:
            return False
        return len(text) <= LONGEST or max(map(len, text.split(" "))) <= LONGEST

    def __call__(self, text, plain):
        if plain and self._ordinary(text):
            return self.ids[self.merges.encode_to_numpy(text)]
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


def _encoder(path):
    """Kept by the Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


_ENCODERS = {}


def pack(docs, tokenizer_path, id_col="doc_id", text="text", capacity=CAPACITY, least=LEAST):
    """One row per piece: the document's id, start, length, ids (little-endian unsigned 32 bits),
    doc_tokens, sequence_id and offset. Every document ends with the id 1.

    A null or empty text is the end id alone. Rows that repeat are packed each. Sequence ids are
    unique, not consecutive. Other columns are not read; an empty table gives no pieces."""
    kind = docs.schema[id_col].dataType.simpleString()

    plain = _encoder(tokenizer_path).plain()

    def start():
        encode = _encoder(tokenizer_path)
        bins = HarmonicBins(TaskContext.get().partitionId() << 33, capacity)
        end = np.array([END_ID], "<u4")

        def step(keys, texts):
            for key, text in zip(keys, texts, strict=True):
                ids = np.concatenate([encode(text or "", plain), end])
                at = 0
                for length in cut_lengths(len(ids), capacity, least):
                    # a copy, so that an open bin does not keep the whole document
                    bins.add((key, at, ids[at : at + length].copy(), len(ids)))
                    at += length
            return bins.taken()

        def finish():
            bins.flush()
            return bins.taken()

        step.finish = finish
        return step

    return map_batches(docs.select(id_col, text), PIECES.format(id=f"`{id_col}` {kind}"), start)
