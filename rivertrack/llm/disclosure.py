"""Personal data, and the terms around it that give it away.

Masking an address or a number is not enough where the words beside it tell whose it was. How
much a term tells is estimated from the whole corpus: of the texts that hold term t, in how many
does t stand within ``WINDOW`` words of entity e? Knowing t, e keeps -log2 of that share in bits
of its information. A term that leaves at most ``BITS_LEFT`` bits, seen near e in at least
``MIN_TEXTS`` different texts, discloses e. In documents where it stands near e every occurrence
of it is generalised, to the shape of the word, or removed if the shape alone discloses as much.

Texts count once however many copies there are. Comparisons are between counts, so no rounding
decides. Documents without personal data have no spans. Nulls: a null text is empty. Rows that
repeat are answered each. No rows, no answers. Matches of one kind never overlap; different
kinds may. No text is searched twice at a place, so time grows with its length whatever it holds.
"""

import re
from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F

from rivertrack.llm.common import map_batches, whole_text, written

KINDS = ("email", "ip", "card", "phone")  # personal data, in the order that breaks ties
GENERALISE, REMOVE = "generalise", "remove"
WINDOW = 8  # words on either side of an entity
MIN_TEXTS = 3  # different texts in which a term must stand near an entity
BITS_LEFT = 1  # information about the entity that a disclosing term leaves, at most
MOST_BROADCAST = 200_000  # rows, and terms in them, that are sent to every task; else a shuffle
FIRST_LOOK = "00"  # texts whose hash begins so (1 in 256) are counted first

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match always begins where its digits do, so no other place need be tried
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"[^\W_]+")


def _emails(text):
    done = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            done = m.end()
            yield start, done, text[start:done].lower()


def _ips(text):
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            yield m.start(), m.end(), ".".join(parts)


def _luhn(digits):
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d // 10 + d % 10 for d in doubled)) % 10 == 0


def _cards(text):
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NO_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and _luhn(digits):
                yield m.start(), m.end(), digits


def _phones(text):
    for m in _PHONE.finditer(text):
        digits = _NO_DIGIT.sub("", m.group())
        if 9 <= len(digits) <= 15:
            yield m.start(), m.end(), digits


def entities(text):
    """[(kind, start, end, entity)] in code points, by start, then by kind; the entity is written
    alike however its matches are."""
    found = [("email", *x) for x in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [("ip", *x) for x in _ips(text)] + [("card", *x) for x in _cards(text)]
        if "+" in text:
            found += [("phone", *x) for x in _phones(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


@lru_cache(maxsize=1 << 16)
def shape(word):
    """What is left of a word if only the kinds of its characters are told: ``<Aa9>``."""
    kinds = ["9" if c.isdigit() else "A" if c.isupper() else "a" for c in word]
    return "<" + "".join(k for i, k in enumerate(kinds) if i == 0 or kinds[i - 1] != k) + ">"


def _free_words(text, found):
    """(start, end, word) outside of all matches, and the starts alone."""
    spans = sorted((start, end) for _, start, end, _ in found)
    words, at, covered = [], 0, 0
    for m in _WORD.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            covered = max(covered, spans[at][1])
            at += 1
        if m.start() >= covered:
            words.append((m.start(), m.end(), m.group()))
    return words, [w[0] for w in words]


def contexts(text):
    """entity -> terms and shapes within ``WINDOW`` words of any of its matches."""
    found = entities(text)
    near = {}
    if found:
        words, starts = _free_words(text, found)
        for kind, start, end, entity in found:
            before, after = bisect_left(starts, start), bisect_left(starts, end)
            close = words[max(0, before - WINDOW) : before] + words[after : after + WINDOW]
            seen = near.setdefault(f"{kind}:{entity}", set())
            for *_, word in close:
                seen.update((word.lower(), shape(word)))
    return near


def _hashed(docs, text):
    """The texts, null as empty, and their hashes."""
    texts = docs.select(whole_text(text).alias("t"))
    return texts.withColumn("hash", F.md5("t"))


def mentions(docs, text="text"):
    """(hash, entity, terms): each different text that holds an entity, once, with the terms near
    it."""

    def start():
        def step(hashes, texts):
            rows = [
                (h, entity, sorted(terms))
                for h, t in zip(hashes, texts, strict=True)
                for entity, terms in contexts(t).items()
            ]
            return list(zip(*rows, strict=True)) or [(), (), ()]

        return step

    rows = map_batches(
        _hashed(docs, text).select("hash", "t"), "hash string, entity string, terms array<string>", start
    )
    return rows.groupBy("hash", "entity").agg(F.first("terms").alias("terms"))


def _texts_with(texts, wanted, known):
    """term -> number of different texts that hold it, for the terms of the table ``wanted``.
    ``known`` is the same terms as a set if they are few; else all terms go through a join."""

    def start():
        def step(hashes, all_texts):
            rows = []
            for h, t in zip(hashes, all_texts, strict=True):
                words = set(_WORD.findall(t))
                terms = {w.lower() for w in words} | {shape(w) for w in words}
                if known is not None:
                    terms &= known
                if terms:
                    rows.append((h, list(terms)))
            return list(zip(*rows, strict=True)) or [(), ()]

        return step

    held = map_batches(texts.select("hash", "t"), "hash string, terms array<string>", start)
    held = held.select(F.unhex("hash").alias("hash"), F.explode("terms").alias("term"))
    if known is None:
        held = held.join(wanted, "term", "left_semi")
    return held.groupBy("term").agg(F.count_distinct("hash").alias("n_term"))


def _few(table):
    """The terms of a table as a set; None if they are too many to send."""
    found = table.select("term").limit(MOST_BROADCAST + 1).collect()
    return {r.term for r in found} if len(found) <= MOST_BROADCAST else None


def disclosures(docs, near, text="text"):
    """(entity, term, n_both, n_term, bits_left) of all terms and shapes that disclose an entity.

    A term is counted over the whole corpus only if it can still disclose: texts with it must
    not outnumber those where it stands near one entity by more than ``BITS_LEFT`` allows. A
    first count on a 256th of the texts already rules out the frequent ones: more texts than
    that bound there are more texts than it anywhere."""
    texts = _hashed(docs, text)
    both = (
        near.select("entity", F.explode("terms").alias("term"))
        .groupBy("entity", "term")
        .agg(F.count(F.lit(1)).alias("n_both"))
        .where(F.col("n_both") >= MIN_TEXTS)
    )
    both = written(both, "near-terms")
    most = both.groupBy("term").agg(F.max(F.col("n_both") * 2**BITS_LEFT).alias("most"))
    first = _texts_with(texts.where(F.col("hash").startswith(FIRST_LOOK)), most, _few(most))
    rare = most.join(first, "term", "left").where(F.coalesce("n_term", F.lit(0)) <= F.col("most"))
    rare = written(rare.select("term", "most"), "rare-terms")
    counts = _texts_with(texts, rare, _few(rare))
    return (
        both.join(counts, "term")
        .where(F.col("n_term") <= F.col("n_both") * 2**BITS_LEFT)
        .withColumn("bits_left", F.log2(F.col("n_term") / F.col("n_both")))
        .select("entity", "term", "n_both", "n_term", "bits_left")
    )


def _revealing(docs, text):
    """(hash, terms) of the texts near whose entities a disclosing term stands."""
    near = written(mentions(docs, text), "mentions")
    told = written(disclosures(docs, near, text), "disclosures")
    pairs = near.select("hash", "entity", F.explode("terms").alias("term"))
    found = pairs.join(told.select("entity", "term"), ["entity", "term"], "left_semi")
    found = written(
        found.groupBy("hash").agg(F.collect_set("term").alias("terms")), "revealing-terms"
    )
    size = found.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("terms")).alias("s")).first()
    return F.broadcast(found) if size.n + (size.s or 0) <= MOST_BROADCAST else found


def find(text, terms):
    """[(kind, start, end)] by start, then by kind: the personal data of a text, and the words of
    ``terms`` outside of it."""
    found = entities(text)
    spans = [(kind, start, end) for kind, start, end, _ in found]
    if terms:
        terms = set(terms)
        for start, end, word in _free_words(text, found)[0]:
            if word.lower() in terms:
                spans.append((REMOVE if shape(word) in terms else GENERALISE, start, end))
    order = (*KINDS, GENERALISE, REMOVE)
    return sorted(spans, key=lambda s: (s[1], order.index(s[0])))


def _with_terms(docs, text):
    """Every row whole, as one struct, so that no name can clash; its text; the terms to hide."""
    rows = docs.select(F.struct("*").alias("row"), whole_text(text).alias("t"))
    rows = rows.withColumn("hash", F.md5("t"))
    return rows.join(_revealing(docs, text), "hash", "left").select("row", "t", "terms")


_SPANS = "array<struct<kind: string, start: bigint, end: bigint>>"


def scan(docs, id_col="doc_id", text="text"):
    """One row (id, spans) per row of ``docs``."""

    def spans(texts: pa.Array, terms: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        said = zip(texts.to_pylist(), terms.to_pylist(), strict=True)
        rows = [
            [{"kind": k, "start": a, "end": b} for k, a, b in find(text, hidden)]
            for text, hidden in said
        ]
        return pa.array(rows, kind)

    found = F.arrow_udf(spans, _SPANS)
    rows = _with_terms(docs, text)
    return rows.select(F.col(f"row.`{id_col}`").alias(id_col), found("t", "terms").alias("spans"))


def sanitise(docs, text="text"):
    """``docs`` with personal data replaced by its kind, disclosing words by their shape, or by
    nothing where that would tell as much; same columns and rows. A null text stays null."""

    def mask(texts: pa.Array, terms: pa.Array) -> pa.Array:
        out = []
        for text, hidden in zip(texts.to_pylist(), terms.to_pylist(), strict=True):
            parts, at = [], 0
            for kind, start, end in find(text, hidden):
                if end <= at:
                    continue
                if start >= at:
                    word = shape(text[start:end]) if kind == GENERALISE else f"[{kind}]"
                    parts += [text[at:start], "" if kind == REMOVE else word]
                at = end
            out.append("".join([*parts, text[at:]]))
        return pa.array(out, pa.string())

    masked = F.arrow_udf(mask, "string")
    rows = _with_terms(docs, text).withColumn("_masked", masked("t", "terms"))
    return rows.select(
        *[
            F.when(F.col(f"row.`{c}`").isNotNull(), F.col("_masked")).alias(c)
            if c == text
            else F.col(f"row.`{c}`").alias(c)
            for c in docs.columns
        ]
    )
