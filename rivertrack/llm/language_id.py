"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word in both directions and gives every position a probability
for each language; a document's probability is the mean over all its positions. Its state starts
afresh at white space (and between characters after LONGEST bytes), so a word gives the same
answer wherever it stands: each distinct word is read once and its positions are then counted for
every document that holds it. No part of any text is left out.

Training is numpy on the driver, by backpropagation through time, from a bounded sample: at most
PER_LANGUAGE documents of each language, MOST_SAMPLED (or one a language) in all, and WORDS_EACH
words, evenly spaced, of each document.
"""

import re

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from rivertrack.llm.common import map_batches

PER_LANGUAGE = 300  # documents of a language that training may see
MOST_SAMPLED = 60_000  # documents that training may see
PLACES = 1 << 62  # of hashes by which rows are drawn
MOST_BROADCAST = 100_000  # languages whose shares are sent to every task; else a shuffle
WORDS_EACH = 60  # words of each
LONGEST = 24  # bytes read in one go, at most
HIDDEN, BATCH, PASSES, RATE, SEED = 16, 512, 3, 0.01, 7
MOST_WORDS = 400_000  # remembered by a Python worker, fewer where languages are many
MOST_SUMS = 32_000_000  # numbers remembered
MOST_SCORES = 4_000_000  # probabilities computed at a time
_LETTER = re.compile(r"[^\W\d_]")


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


class Network:
    """Parameters: per direction ``W`` (byte -> three gates, which is embedding and input weights
    in one), ``U`` (state -> gates), ``b``; ``V`` and ``c`` map both states to languages."""

    def __init__(self, languages, hidden=HIDDEN, seed=SEED):
        self.languages, self.hidden = list(languages), hidden
        rng = np.random.default_rng(seed)
        n = len(self.languages)

        def normal(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.p = {"V": normal(2 * hidden, n, scale=0.2), "c": np.zeros(n, np.float32)}
        for d in "fb":
            self.p |= {
                f"W{d}": normal(256, 3 * hidden, scale=0.3),
                f"U{d}": normal(hidden, 3 * hidden, scale=hidden**-0.5),
                f"b{d}": np.zeros(3 * hidden, np.float32),
            }

    def _read(self, x, d, keep=False):
        """States after each of the bytes ``x`` (words, length) in direction ``d``."""
        h3, W, U, b = self.hidden, self.p[f"W{d}"], self.p[f"U{d}"], self.p[f"b{d}"]
        times = range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1)
        h = np.zeros((len(x), h3), np.float32)
        states, steps = np.empty((x.shape[1], len(x), h3), np.float32), []
        for t in times:
            a, u = W[x[:, t]] + b, h @ U
            gates = _sigmoid(a[:, : 2 * h3] + u[:, : 2 * h3])
            z, r = gates[:, :h3], gates[:, h3:]
            n = np.tanh(a[:, 2 * h3 :] + r * u[:, 2 * h3 :])
            if keep:
                steps.append((t, h, z, r, n, u[:, 2 * h3 :]))
            h = n + z * (h - n)
            states[t] = h
        return states, steps

    def probabilities(self, x, keep=False):
        """(length, words, languages), and what backpropagation needs."""
        forward, f_steps = self._read(x, "f", keep)
        backward, b_steps = self._read(x, "b", keep)
        both = np.concatenate([forward, backward], axis=2)
        scores = both @ self.p["V"] + self.p["c"]
        scores -= scores.max(axis=2, keepdims=True)
        e = np.exp(scores)
        return e / e.sum(axis=2, keepdims=True), (both, f_steps, b_steps)

    def gradients(self, x, y):
        """Of the mean cross-entropy over all positions; every position has its word's label."""
        prob, (both, f_steps, b_steps) = self.probabilities(x, keep=True)
        length, words, _ = prob.shape
        loss = -np.log(prob[:, np.arange(words), y] + 1e-9).mean()
        d_score = prob
        d_score[:, np.arange(words), y] -= 1
        d_score /= length * words
        g = {"V": np.einsum("twh,twl->hl", both, d_score), "c": d_score.sum(axis=(0, 1))}
        d_both = d_score @ self.p["V"].T
        h3 = self.hidden
        for d, steps, d_states in (("f", f_steps, d_both[:, :, :h3]), ("b", b_steps, d_both[:, :, h3:])):
            U = self.p[f"U{d}"]
            gW, gU = np.zeros_like(self.p[f"W{d}"]), np.zeros_like(U)
            gb = np.zeros(3 * h3, np.float32)
            dh = np.zeros((words, h3), np.float32)
            for t, h, z, r, n, un in reversed(steps):
                dh = dh + d_states[t]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * un * r * (1 - r)
                da = np.concatenate([dz, dr, dn], axis=1)
                du = np.concatenate([dz, dr, dn * r], axis=1)
                np.add.at(gW, x[:, t], da)
                gU += h.T @ du
                gb += da.sum(axis=0)
                dh = dh * z + du @ U.T
            g |= {f"W{d}": gW, f"U{d}": gU, f"b{d}": gb}
        return g, loss

    def fit(self, words, labels, passes=PASSES, batch=BATCH, rate=RATE, seed=SEED):
        """Adam over batches of words of equal length. ``words`` are byte strings."""
        rng = np.random.default_rng(seed)
        by_length = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        data = {
            n: (np.frombuffer(b"".join(words[i] for i in at), np.uint8).reshape(-1, n), labels[at])
            for n, at in by_length.items()
        }
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        for _ in range(passes):
            plan = []
            for n, (x, _y) in data.items():
                order = rng.permutation(len(x))
                plan += [(n, order[a : a + batch]) for a in range(0, len(x), batch)]
            for i in rng.permutation(len(plan)):
                n, at = plan[i]
                g, _ = self.gradients(data[n][0][at], data[n][1][at])
                step += 1
                # a batch of few words moves the weights less
                pace = rate * min(1.0, len(at) / 64) / (1 - 0.9**step) * (1 - 0.999**step) ** 0.5
                for k, grad in g.items():
                    m[k] += 0.1 * (grad - m[k])
                    v[k] += 0.001 * (grad * grad - v[k])
                    self.p[k] -= (pace * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
        return self


def pieces(text):
    """The words of a text as bytes, cut into at most LONGEST bytes between characters. Together
    they hold every byte that is not ASCII white space."""
    words = text.encode().split()
    if words and max(map(len, words)) > LONGEST:
        words = [part for w in words for part in _cut(w)]
    return words


def _cut(word):
    parts, at = [], 0
    while len(word) - at > LONGEST:
        end = at + LONGEST
        while word[end] & 0xC0 == 0x80:  # inside a character
            end -= 1
        parts.append(word[at:end])
        at = end
    return [*parts, word[at:]]


class Reader:
    """Documents -> sums over their positions, in one Python worker. Remembers per word the
    probabilities summed over its positions and how many positions each language labels."""

    def __init__(self, network, most=MOST_WORDS):
        self.network, self.most = network, min(most, MOST_SUMS // (2 * len(network.languages)))
        self.known, self.rows = {}, np.zeros((0, 2 * len(network.languages)), np.float32)

    def _learn(self, unseen):
        if len(self.known) + len(unseen) > self.most:
            self.known.clear()
            self.rows = self.rows[:0]
        new = sorted(unseen.difference(self.known), key=len)
        rows, a = [self.rows], 0
        while a < len(new):
            n, b = len(new[a]), a
            at_once = max(1, min(8192, MOST_SCORES // (n * len(self.network.languages))))
            while b < len(new) and len(new[b]) == n and b - a < at_once:
                b += 1
            x = np.frombuffer(b"".join(new[a:b]), np.uint8).reshape(-1, n)
            prob, _ = self.network.probabilities(x)
            label = prob == prob.max(axis=2, keepdims=True)
            rows.append(np.concatenate([prob.sum(axis=0), label.sum(axis=0)], axis=1, dtype=np.float32))
            a = b
        start = len(self.known)
        self.known.update(zip(new, range(start, start + len(new)), strict=True))
        self.rows = np.concatenate(rows)

    def sums(self, words):
        out = np.zeros(self.rows.shape[1], np.float64)
        for a in range(0, len(words), 100_000):
            part = words[a : a + 100_000]
            at = np.fromiter(map(self.known.__getitem__, part), np.int64, len(part))
            out += self.rows[at].sum(axis=0, dtype=np.float64)
        return out

    def __call__(self, texts, group=40_000):
        """Sums for each text. Words are learned for about ``group`` words at a time."""
        out, held, count = [], [], 0
        for text in texts:
            words = pieces(text)
            if len(words) > group:  # a long text is read in stretches
                total = np.zeros(self.rows.shape[1], np.float64)
                out += self._flush(held)
                held, count = [], 0
                for a in range(0, len(words), group):
                    total += self._flush([words[a : a + group]])[0]
                out.append(total)
                continue
            held.append(words)
            count += len(words)
            if count >= group:
                out += self._flush(held)
                held, count = [], 0
        return out + self._flush(held)

    def _flush(self, held):
        self._learn({w for words in held for w in words})
        return [self.sums(words) for words in held]


def remainder(id_col):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def train(docs, rows, id_col="doc_id", text="text", lang="lang"):
    """A network fitted on the rows of ``docs`` for which ``rows`` (a condition) holds and text
    and lang are known. Every language of theirs is learned. The driver sees the number of
    languages and the sample, whose bound does not grow with the table. None if there is no such
    row."""
    usable = docs.filter(rows & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = usable.groupBy(F.col(lang).alias("_lang")).agg(F.count(F.lit(1)).alias("_n"))
    known = counts.count()
    each = max(1, min(PER_LANGUAGE, MOST_SAMPLED // max(1, known)))
    # a share of each language by hash that gives somewhat more than needed, then the least of it
    share = counts.select("_lang", (F.least(F.lit(1.0), 1.5 * each / F.col("_n")) * float(PLACES)).alias("_share"))
    place = F.pmod(F.xxhash64(id_col, F.lit(SEED)), F.lit(PLACES))
    some = usable.select(place.alias("_place"), F.col(lang).alias("_lang"), F.col(text).alias("_text"))
    some = some.join(F.broadcast(share) if known <= MOST_BROADCAST else share, "_lang")
    some = some.filter(F.col("_place") <= F.col("_share"))
    first = Window.partitionBy("_lang").orderBy("_place", F.xxhash64("_text"))
    some = some.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= each)

    def start():
        def step(places, langs, texts):
            words = [pieces(t) for t in texts]
            return places, langs, [w[:: max(1, len(w) // WORDS_EACH)][:WORDS_EACH] for w in words]

        return step

    schema = "place bigint, lang string, words array<binary>"
    sample = sorted(map_batches(some.select("_place", "_lang", "_text"), schema, start).collect())
    if not sample:
        return None
    languages = sorted({row.lang for row in sample})
    number = {x: i for i, x in enumerate(languages)}
    words = [bytes(w) for row in sample for w in row.words]
    labels = [number[row.lang] for row in sample for _ in row.words]
    return Network(languages).fit(words, np.array(labels, np.int64))


_READERS = {}


def predict(docs, network, id_col="doc_id", text="text", keep=()):
    """One row (id, *keep, lang_pred, score, n_positions, n_agree) per row of ``docs``, read from
    the text alone: the likeliest language, its mean probability over all positions, the number
    of positions and how many of them are labelled with it.

    ``und`` with score 0 for a null or empty text, one without a letter, or without a network.
    Repeated rows are answered each; an empty table gives an empty result."""
    name = hash(b"".join(v.tobytes() for v in network.p.values())) if network else None

    def start():
        if network is not None and name not in _READERS:
            _READERS.clear()
            _READERS[name] = Reader(network)

        def step(*columns):
            texts, out = columns[-1], []
            lettered = [bool(t and _LETTER.search(t)) and network is not None for t in texts]
            sums = iter(_READERS[name](t for t, ok in zip(texts, lettered, strict=True) if ok) if network else ())
            for ok in lettered:
                if not ok:
                    out.append(("und", 0.0, 0, 0))
                    continue
                row = next(sums)
                n = len(network.languages)
                best, positions = int(row[:n].argmax()), row[:n].sum()
                out.append((network.languages[best], min(1.0, row[best] / positions), round(positions), int(row[n + best])))
            return [*columns[:-1], *(list(c) for c in zip(*out, strict=True))]

        return step

    kept = [id_col, *keep]
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept]
    schema = ", ".join([*fields, "lang_pred string, score double, n_positions bigint, n_agree bigint"])
    return map_batches(docs.select(*kept, text), schema, start)


def held_out_languages(docs, id_col="doc_id", text="text", lang="lang"):
    """Train on the rows whose id's remainder is not 2, predict all rows, and say which were held
    out. A null id is neither trained on nor held out."""
    network = train(docs, remainder(id_col) != 2, id_col, text, lang)
    held = docs.withColumn("held_out", F.coalesce(remainder(id_col) == 2, F.lit(False)))
    return predict(held, network, id_col, text, keep=("held_out",))
