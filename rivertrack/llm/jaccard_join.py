"""N-gram Jaccard join of all documents, exact, by index lists and relations between sets.

Equal sets are one class and count once. A class is indexed under parts of itself: the shingles
of a set fall by their hash into slightly more parts than two sets of its size that link can
differ in shingles, so such sets have a whole part in common. A list holds the sets that
share a part; as a part is some ten shingles from all over a text, a list holds sets that are
alike, not all texts with a common passage. Sets of one level of size, or of neighbours, are cut
alike; lists of other sizes are skipped. Sets that link share more than one part, by a number that
follows from their sizes, so each set leaves that many less one of its lists, the longest. The
length of the shingles and the threshold are arguments.

A list is not turned into all its pairs. First, every set is compared with its anchor, the one set
that leads its lists; the components of the links found so far settle most lists, as sets already
connected need no comparison. What lists still hold of different components is found in two ways
that share the work by list. In a short list each set meets the others; of two sets with the same
anchor, bounds on what they share are derived from what each shares with it, and only pairs
that these leave undecided are compared. The sets of longer lists come in blocks, and only blocks
that meet in such a list, at sizes that can link, are compared. Inside a pair of blocks a set's
overlap with all others is derived from its difference to one pivot set: |x & y| is |p| less what
either lacks of p plus what both have beside p, all read from the differences.
"""

import math
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from rivertrack.llm.common import clustered, dropped, map_batches, short_batches, whole_text, written
from rivertrack.llm.components import components

WORDS = 3
PERCENT = 90
LARGEST = 1 << 40  # shingles of a set, beyond which levels of size do not go
SHORT = 64  # sets of a list that meet one by one
BLOCK = 512  # sets
HOPS = 3  # anchors after a set's own that lead to its home
MOST_WORDS = 100_000  # words whose hashes a worker remembers, some 200 bytes each
MOST_SEEN = 500_000  # names of sets that a task remembers
PER_CHUNK = 2000  # sets compared with one copy of their anchor
MOST_BROADCAST = 400_000  # ids or roles of sets to compare, some 80 bytes each

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_PLACES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9]  # odd factors of a shingle's first words
_MIX = np.uint64(0xFF51AFD7ED558CCD)


class _Words(dict):
    def __missing__(self, word):
        if len(self) >= MOST_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


@cache
def _place(i):
    """The factor of a shingle's word ``i``."""
    return np.uint64(_PLACES[i] if i < len(_PLACES) else xxhash.xxh3_64_intdigest(f"place {i}") | 1)


def shingles(text, length=WORDS):
    """The distinct shingles of ``length`` words of a text as sorted 64-bit hashes. A-Z is
    lower-cased and the six ASCII white-space characters separate words; fewer words than
    ``length`` are one shingle, none have none."""
    words = (text or "").encode().translate(_LOWER).split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    if n < length:
        h = np.append(h, np.full(length - n, n, np.uint64))
    count = len(h) - length + 1
    s = h[:count] * _place(0)
    for i in range(1, length):
        s += h[i : i + count] * _place(i)
    s ^= s >> np.uint64(32)
    s *= _MIX
    s ^= s >> np.uint64(29)
    return np.unique(s)


def _key(found):
    """A 128-bit name of a set as two signed numbers."""
    digest = xxhash.xxh3_128_digest(found.tobytes())
    return np.frombuffer(digest, "<i8").tolist()


def _signed(a):
    return a.astype(np.uint64).view(np.int64)


def said(text="text"):
    return F.xxhash64(whole_text(text)).alias("said")


def summarise(docs, id_col="doc_id", text="text", percent=PERCENT, words=WORDS):
    """One pass over the texts: a row (id, said, n, hi, lo, even, odd) per document, ``said`` being a hash
    of its text, n the size of its set, hi, lo the set's name and even, odd the parts it can spare."""
    kind = docs.schema[id_col].dataType.simpleString()

    def start():
        def step(ids, said, texts):
            found = [shingles(t, words) for t in texts]
            names = [(*_key(f), *spared(f, percent)) for f in found]
            return [ids, said, [len(f) for f in found], *zip(*names, strict=True)]

        return step

    schema = f"id {kind}, said bigint, n bigint, hi bigint, lo bigint, even int, odd int"
    return map_batches(docs.select(id_col, said(text), text), schema, start)


@cache
def levels(percent):
    """The least size of each level. Sets that link are of one level or of neighbours."""
    out = [1]
    while out[-1] < LARGEST:
        out.append(100 * out[-1] // percent + 1)
    return np.array(out)


@cache
def parts_of(level, percent):
    """(parts, spare) into which sets of ``level`` and the next are cut, or None if no two of them
    link unless they are equal. Two that link, one of them of ``level``, differ in fewer shingles
    than there are parts, less the spare ones: they share spare + 1 whole parts at least. A set of
    ``level`` is unlikely to leave more than ``spare`` parts empty."""
    least, most = int(levels(percent)[level]), int(levels(percent)[level + 1]) - 1
    differ = (most + 100 * most // percent) * (100 - percent) // (100 + percent)
    if differ < 1:
        return None
    empty = (differ + 1) * math.exp(-least / (differ + 1))
    spare = math.ceil(empty + 4 * math.sqrt(empty)) + 1
    return differ + 1 + spare, spare


def _cuts(n, percent):
    """(level, parts, spare) by which a set of ``n`` is cut: its own level's, and that of the level below."""
    if percent >= 100 or not n:
        return []
    own = int(np.searchsorted(levels(percent), n, "right")) - 1
    cuts = [(level, parts_of(level, percent)) for level in (own - 1, own) if level >= 0]
    return [(level, *cut) for level, cut in cuts if cut is not None]


def _part(found, parts):
    return (found >> np.uint64(11)) % np.uint64(parts)


def signatures(found, percent):
    """The names of a set's parts, 64 bits each: parts of its own level, and of the level below for
    the sets there. Empty parts have names only in a set with more of them than are spare: of two
    such sets, and of two others, one part that has a name is the same. A name is odd if the level is."""
    mixed, out = found * _MIX ^ found >> np.uint64(31), []
    for level, parts, spare in _cuts(len(found), percent):
        of = _part(found, parts)
        order = np.argsort(of, kind="stable")
        here, starts = np.unique(of[order], return_index=True)
        sums = np.add.reduceat(mixed[order], starts)
        if parts - len(here) > spare:
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), here)
            here, sums = np.concatenate([here, empty]), np.concatenate([sums, np.zeros(len(empty), np.uint64)])
        cut_as = np.array([level, parts], np.uint64) * np.array([_place(1), _place(2)])
        name = sums + here * _place(0) + cut_as.sum()
        name = (name ^ name >> np.uint64(29)) * _MIX
        name ^= name >> np.uint64(32)
        out.append(name >> np.uint64(1) << np.uint64(1) | np.uint64(level % 2))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def spared(found, percent):
    """How many of its named parts a set can do without, as (of even levels, of odd ones). Two sets
    that link share more named parts than either one's number: all but those that their differing
    shingles fall into and those empty in both. A set with many empty parts can spare none."""
    n, out = len(found), [0, 0]
    for level, parts, spare in _cuts(n, percent):
        empty = parts - len(np.unique(_part(found, parts)))
        if empty <= spare:
            most = min(100 * n // percent, int(levels(percent)[level + 2]) - 1)
            if n >= levels(percent)[level + 1]:  # cut for those of the level below
                most = int(levels(percent)[level + 1]) - 1
            differ = (n + most) * (100 - percent) // (100 + percent)
            out[level % 2] = max(parts - differ - empty - 1, 0)
    return out


def postings(docs, text="text", percent=PERCENT, words=WORDS):
    """Rows (token, hi): the parts of every document's set, without a shuffle. ``hi`` is half of
    the set's name; the rest follows once most places are ruled out. Of equal sets a task
    names one, until it has seen MOST_SEEN others."""

    def start():
        seen = set()

        def step(texts):
            out = []
            for t in texts:
                found = shingles(t, words)
                name = _key(found)[0]
                if name in seen:
                    continue
                if len(seen) >= MOST_SEEN:
                    seen.clear()
                seen.add(name)
                tokens = _signed(signatures(found, percent))
                out.append((tokens, np.full(len(tokens), name)))
            return [np.concatenate(x) for x in zip(*out, strict=True)] if out else []

        return step

    return map_batches(docs.select(text), "token bigint, hi bigint", start)


def _level(percent):
    """Sizes by powers of 100/percent."""
    return F.floor(F.log("n") / math.log(100 / percent)).cast("int")


def shared_lists(index, classes):
    """Rows (token, key, n) of the lists that hold several classes, one per class. The index lies in
    files by token, so that its lists are found where they lie. A class leaves the longest of
    its lists, as many as it has parts to spare: lists are left in one order by all, so the first
    list by this order that two linked sets share is one that neither leaves. What many sets have
    in common, linked or not, thus brings together only those that have still more in common."""
    several = index.groupBy("token").agg(F.min("hi").alias("a"), F.max("hi").alias("b"))
    several = several.filter("a != b").select("token")
    rows = index.join(several, "token").dropDuplicates(["token", "hi"])
    rows = rows.join(classes.select("hi", "key", "n", "even", "odd"), "hi")
    odd = F.col("token") % 2 != 0
    rows = rows.select("token", "key", "n", F.when(odd, F.col("odd")).otherwise(F.col("even")).alias("spared"))
    rows = written(rows, "jaccard-shared")
    held = rows.groupBy("token").agg(F.count(F.lit(1)).alias("held"))
    longest = Window.partitionBy("key", odd).orderBy(F.desc("held"), "token")
    kept = rows.join(held, "token").withColumn("place", F.row_number().over(longest)).filter("place > spared")
    kept = written(kept.select("token", "key", "n"), "jaccard-kept")
    dropped(rows)
    several = kept.groupBy("token").count().filter("count > 1").select("token")
    out = written(kept.join(several, "token"), "jaccard-lists")
    dropped(kept)
    return out


def shipped(docs, classes, roles, order, id_col="doc_id", text="text", words=WORDS):
    """The sets of the classes in ``roles`` (key, ...), one row per role (its columns, shingles),
    read from one document of each class and dealt out by ``order``. The documents' ids and the
    roles are broadcast while they are few (counted), so that sets are sent once; otherwise they
    are shuffled."""
    roles = written(roles, "jaccard-roles")
    ids = classes.join(roles.select("key").distinct(), "key").select("key", "rep", "rep_said")
    ids = written(ids, "jaccard-roles")
    few = ids.count() <= MOST_BROADCAST
    texts = docs.select(F.col(id_col).alias("_id"), said(text), F.col(text).alias("_text"))
    same = F.col("_id").eqNullSafe(F.col("rep")) & (F.col("said") == F.col("rep_said"))
    chosen = texts.join(F.broadcast(ids) if few else ids, same)

    def start():
        def step(keys, texts):
            return keys, [shingles(t, words).tobytes() for t in texts]

        return step

    sets = map_batches(chosen.select("key", "_text"), "key bigint, shingles binary", start)
    if roles.count() <= MOST_BROADCAST:
        roles = F.broadcast(roles)
    return sets.join(roles, "key").repartition(*order)


def _similar(both, n, m, percent):
    return 100 * both >= percent * (n + m - both)


def with_anchors(lists):
    """The rows of ``lists`` with their set's anchor (token, key, n, anchor, anchor_n): each list is
    led by the set with most places, and of the leaders of a set's lists the one with most places
    is its anchor. Near copies have the same anchor. A set's places are as many as its parts."""
    own = Window.partitionBy("key")
    placed = lists.withColumn("places", F.count(F.lit(1)).over(own))
    best = F.max(F.struct("places", "key", "n")).alias("b")
    leaders = placed.groupBy("token").agg(best).select("token", F.col("b.key").alias("leader"), F.col("b.n").alias("leader_n"), "b.places")
    rows = lists.join(leaders, "token").withColumn("b", F.max(F.struct("places", "leader", "leader_n")).over(own))
    return rows.select("token", "key", "n", F.col("b.leader").alias("anchor"), F.col("b.leader_n").alias("anchor_n"))


def _near(n, m, percent):
    """Whether sizes can link."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def anchor_pairs(anchored, percent=PERCENT):
    """Rows (key, anchor) that can link by their sizes."""
    pairs = anchored.filter((F.col("key") != F.col("anchor")) & _near("n", "anchor_n", percent))
    return pairs.select("key", "anchor")


def overlaps(docs, classes, pairs, id_col="doc_id", text="text", words=WORDS):
    """Rows (key, anchor, n, m, both) of ``pairs`` (key, anchor): the sizes of both sets and of
    what they share. An anchor's comparisons are dealt out in chunks of some PER_CHUNK, each with its
    own copy of the anchor's set."""
    many = pairs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > PER_CHUNK)
    chunks = many.select("anchor", F.ceil(F.col("n") / PER_CHUNK).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("key"), F.coalesce("chunks", F.lit(1))).cast("int")
    dealt = pairs.join(chunks, "anchor", "left").select("anchor", chunk.alias("chunk"), "key")
    heads = dealt.select("anchor", "chunk", F.col("anchor").alias("key")).distinct()
    work = shipped(docs, classes, dealt.unionByName(heads), ("anchor", "chunk"), id_col, text, words)
    work = work.sortWithinPartitions("anchor", "chunk", F.col("key") != F.col("anchor"))

    def start():
        state = {}

        def step(anchor, chunk, keys, found):
            out = []
            for head, part, key, raw in zip(anchor, chunk, keys, found, strict=True):
                s = np.frombuffer(raw, np.uint64)
                if key == head:
                    state["at"], state["set"] = (head, part), s
                    continue
                assert state["at"] == (head, part)
                pivot = state["set"]
                at = np.minimum(np.searchsorted(pivot, s), len(pivot) - 1)
                out.append((key, head, len(s), len(pivot), int((pivot[at] == s).sum())))
            return list(zip(*out, strict=True))

        return step

    columns = work.select("anchor", "chunk", "key", "shingles")
    return map_batches(columns, "key bigint, anchor bigint, n bigint, m bigint, both bigint", start)


def links_of(compared, percent=PERCENT):
    """Links (a, b) among compared sets."""
    n, m, both = (F.col(c) for c in ("n", "m", "both"))
    return compared.filter(_similar(both, n, m, percent)).select(F.col("key").alias("a"), F.col("anchor").alias("b"))


def unsettled(rows, labels, compared):
    """The rows (of `with_anchors`) of lists that still hold several components, with their component and whether
    it is not the list's main one, the largest, which is settled in itself, and with what they share
    with their anchor where that was compared. A list of a set and
    its anchor was settled by comparing them."""
    rows = rows.join(labels, rows["key"] == labels["vertex"], "left").select(
        "token", "key", "n", "anchor", "anchor_n", F.coalesce("component", "key").alias("component")
    )
    counts = rows.groupBy("token", "component", "anchor").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("key") == F.col("anchor")).alias("own")
    )
    parts = counts.groupBy("token", "component").agg(
        F.sum("n").alias("n"), F.min("anchor").alias("a"), F.max("anchor").alias("b"), F.max("own").alias("own")
    )
    main = parts.groupBy("token").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"),
        F.count(F.lit(1)).alias("found"), F.sum("n").alias("size"),
        (F.min("a") == F.max("b")).alias("alike"), F.max("own").alias("own"),
    )
    open_lists = main.filter("found > 1 and not (size = 2 and alike and own)").select("token", "main", "size")
    rows = rows.join(open_lists, "token").withColumn("minor", F.col("component") != F.col("main"))
    own = compared.select(F.col("key").alias("of"), F.col("both").alias("shares"))
    rows = rows.join(own, F.col("key") == F.col("of"), "left")
    shares = F.when(F.col("key") == F.col("anchor"), F.col("n")).otherwise(F.col("shares"))
    return rows.select(
        "token", "key", "n", "anchor", "anchor_n", shares.alias("shares"), "component", "minor", "size"
    )


def met_pairs(rows, percent=PERCENT):
    """Pairs (key, anchor, linked) of different components that meet in short lists and are near in
    size, with what their own anchor says of them: ``linked`` is true or false where it decides,
    null where it does not. With p the anchor of both, they share what both have of p at least,
    |x & p| + |y & p| - |p|, and at most the smaller of these and the smaller of what they have
    beside p."""
    names = ["key", "n", "anchor", "anchor_n", "shares", "component", "minor"]
    one = rows.filter("minor").select("token", *[F.col(c).alias(f"{c}1") for c in names])
    two = rows.select("token", *[F.col(c).alias(f"{c}2") for c in names])
    once = ~F.col("minor2") | (F.col("key1") < F.col("key2"))
    met = one.join(two, "token").filter(
        (F.col("component1") != F.col("component2")) & once & _near("n1", "n2", percent)
    )
    n, m, x, y = (F.col(c) for c in ("n1", "n2", "shares1", "shares2"))
    least = x + y - F.col("anchor_n1")
    most = F.least(x, y) + F.least(n - x, m - y)
    same = (F.col("anchor1") == F.col("anchor2")) & x.isNotNull() & y.isNotNull()
    linked = F.when(same & _similar(least, n, m, percent), F.lit(True)).when(
        same & ~_similar(most, n, m, percent), F.lit(False)
    )
    # one of a pair can be minor here and the other one elsewhere
    return met.select(
        F.least("key1", "key2").alias("key"), F.greatest("key1", "key2").alias("anchor"), linked.alias("linked")
    ).distinct()


def homes(anchored):
    """Rows (anchor, home): where a set's anchor leads, over HOPS anchors more. Small groups that
    lean on the sets of a larger one have its home."""
    step = anchored.select("key", F.col("anchor").alias("next"))
    out = anchored.select("anchor").distinct().withColumn("home", F.col("anchor"))
    for _ in range(HOPS):
        out = out.join(step, out["home"] == step["key"], "left")
        out = out.select("anchor", F.coalesce("next", "home").alias("home"))
    return out


def block_links(docs, classes, rows, anchored, id_col="doc_id", text="text", percent=PERCENT, words=WORDS):
    """Links between different components that share a long list. Sets come in blocks of about
    BLOCK, of one level of size and with the same home. Only blocks are compared that
    meet in a list and whose sizes can link. Each pair of blocks is compared once, however many
    lists they share: sets outside some list's main component with the rest."""
    rows = rows.withColumn("level", _level(percent)).join(homes(anchored), "anchor")
    sizes = rows.select("key", "home", "level").distinct().groupBy("home", "level")
    sizes = sizes.agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("key", F.lit(7)), "parts")
    rows = rows.join(sizes, ["home", "level"]).select(
        "token", "key", "n", "component", "minor", F.xxhash64("home", "level", part).alias("block")
    )
    rows = written(rows, "jaccard-blocks")

    def meeting(of, name):
        return of.groupBy("token", F.col("block").alias(f"b{name}")).agg(
            F.min("n").alias(f"low{name}"), F.max("n").alias(f"high{name}")
        )

    near = (100 * F.col("high1") >= percent * F.col("low2")) & (100 * F.col("high2") >= percent * F.col("low1"))
    units = meeting(rows.filter("minor"), 1).join(meeting(rows, 2), "token").filter(near)
    units = written(units.select("b1", "b2").distinct(), "jaccard-units")
    members = rows.groupBy("key", "component", "block").agg(F.max("minor").alias("minor"))
    members = written(members, "jaccard-members")
    probe = units.join(members.filter("minor").withColumnRenamed("block", "b1"), "b1")
    index = units.join(members.withColumnRenamed("block", "b2"), "b2")
    keep = ["b1", "b2", "key", "component"]
    roles = probe.select(*keep, F.lit(True).alias("probe")).unionByName(
        index.select(*keep, F.lit(False).alias("probe"))
    )
    work = shipped(docs, classes, roles, ("b1", "b2"), id_col, text, words)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        return linked(pdf, percent)

    return work.groupBy("b1", "b2").applyInPandas(compare, "a bigint, b bigint")


def linked(pdf, percent=PERCENT):
    """Spanning links between the probing sets of one unit and its indexed sets of other
    components. Overlaps come from differences to the first set, the pivot."""
    probes, others = pdf[pdf["probe"]], pdf[~pdf["probe"]]
    if not len(probes) or not len(others):
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    sets = [np.frombuffer(x, np.uint64) for x in [*probes["shingles"], *others["shingles"]]]
    pivot, k = sets[0], len(probes)
    lacks = [np.setdiff1d(pivot, s, assume_unique=True) for s in sets]
    extra = [np.setdiff1d(s, pivot, assume_unique=True) for s in sets]
    size = np.array([len(s) for s in sets])
    short = np.array([len(x) for x in lacks])

    def common(parts):
        """Sizes of the intersections of parts[:k] with parts[k:]."""
        flat = np.concatenate(parts)
        row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        seen, column = np.unique(flat, return_inverse=True)
        # what only one side has cannot be common
        on_both = np.bincount(column[row < k], minlength=len(seen)).astype(bool)
        on_both &= np.bincount(column[row >= k], minlength=len(seen)).astype(bool)
        used = on_both[column]
        row, column = row[used], (np.cumsum(on_both) - 1)[column[used]]
        seen = seen[on_both]
        out = np.zeros((k, len(parts) - k), np.float32)
        for a in range(0, len(seen), 8192):  # a bounded stretch of columns at a time
            here = (column >= a) & (column < a + 8192)
            table = np.zeros((len(parts), min(8192, len(seen) - a)), np.float32)
            table[row[here], column[here] - a] = 1
            out += table[:k] @ table[k:].T
        return out.astype(np.int64)

    both = len(pivot) - short[:k, None] - short[None, k:] + common(lacks) + common(extra)
    component = pdf["component"]
    of_probe, of_other = component[pdf["probe"]].to_numpy(), component[~pdf["probe"]].to_numpy()
    hit = _similar(both, size[:k, None], size[None, k:], percent) & (of_probe[:, None] != of_other)
    roots, links = {}, []

    def root(c):
        while roots.get(c, c) != c:
            c = roots[c]
        return c

    a_keys, b_keys = probes["key"].to_numpy(), others["key"].to_numpy()
    for i, j in np.argwhere(hit):
        a, b = root(of_probe[i]), root(of_other[j])
        if a != b:
            roots[a] = b
            links.append((a_keys[i], b_keys[j]))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def one_of_each(docs, id_col="doc_id", text="text", percent=PERCENT, words=WORDS):
    """The rows of ``docs`` that carry their component's smallest id, with all their columns and
    only those; of equal rows one stays. Documents without words all stay. A row travels as one
    struct, so that no name can clash."""
    rows = written(jaccard_components(docs, id_col, text, percent, words), "jaccard-components")
    kept = rows.filter(F.col("component_id").eqNullSafe(F.col(id_col))).select(
        F.col(id_col).alias("kept_id"), F.col("said").alias("kept_said")
    )
    repeated = kept.groupBy("kept_id", "kept_said").count().filter("count > 1").take(1)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    marked = docs.select(whole.alias("row"), F.col(id_col).alias("id"), said(text).alias("said"))
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("said") == F.col("kept_said"))
    out = marked.join(kept, same, "left_semi")
    if repeated:
        out = out.dropDuplicates(["id", "said"])
    return out.select("row.*")


def jaccard_components(docs, id_col="doc_id", text="text", percent=PERCENT, words=WORDS):
    """One row (id, said, n_shingles, component_id) per row of ``docs``: a hash of its text, the size of the document's set
    and the smallest id reachable over links, two documents linking when
    100 * |intersection| >= percent * |union| of their shingles of ``words`` words.

    A null or empty text, or one without words, has an empty set, links with nothing and is its
    own component. Equal rows and equal texts are one class. A null id is never the smallest
    unless there is no other. Shingles are compared by 64-bit and sets by 128-bit hashes."""
    short_batches(docs.sparkSession)
    members = summarise(docs, id_col, text, percent, words).withColumnRenamed("n", "n_shingles")
    members = written(members, "jaccard-summary")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "said"))  # a null id comes last
    classes = members.filter("n_shingles > 0").groupBy("hi", "lo")
    classes = classes.agg(least.alias("r"), F.first("n_shingles").alias("n"), F.first("even").alias("even"), F.first("odd").alias("odd"))
    # numbered once, as they are written
    classes = classes.select(
        "hi", "lo", "n", "even", "odd", F.col("r.id").alias("rep"), F.col("r.said").alias("rep_said"),
        F.monotonically_increasing_id().alias("key"),
    )
    classes = written(classes, "jaccard-classes")
    index = clustered(postings(docs, text, percent, words), "jaccard-index", ("token",), ("hi",))
    lists = shared_lists(index, classes)
    dropped(index)
    rows = written(with_anchors(lists), "jaccard-lists")
    dropped(lists)
    anchored = written(rows.select("key", "n", "anchor", "anchor_n").distinct(), "jaccard-anchors")
    near = anchor_pairs(anchored, percent)
    compared = written(overlaps(docs, classes, near, id_col, text, words), "jaccard-overlaps")
    links = links_of(compared, percent)
    labels = written(components(links), "jaccard-labels")
    rest = written(unsettled(rows, labels, compared), "jaccard-unsettled")
    dropped(rows, labels)
    met = written(met_pairs(rest.filter(F.col("size") <= SHORT), percent), "jaccard-met")
    open_pairs = met.filter("linked is null").select("key", "anchor")
    more = links_of(overlaps(docs, classes, open_pairs, id_col, text, words), percent)
    long = rest.filter(F.col("size") > SHORT)
    more = more.unionByName(block_links(docs, classes, long, anchored, id_col, text, percent, words))
    more = more.unionByName(met.filter("linked").select(F.col("key").alias("a"), F.col("anchor").alias("b")))
    more = written(more, "jaccard-links")
    dropped(rest, met)
    labels = written(components(links.unionByName(more)), "jaccard-labels")
    dropped(compared, anchored, more)
    # every class with its component, every component with its smallest id
    placed = classes.join(labels, classes["key"] == labels["vertex"], "left").select(
        "hi", "lo", "rep", F.coalesce("component", "key").alias("component")
    )
    smallest = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = placed.join(smallest, "component").select("hi", "lo", "component_id")
    return members.join(named, ["hi", "lo"], "left").select(
        F.col("id").alias(id_col), "said", "n_shingles",
        F.coalesce("component_id", F.when(F.col("n_shingles") == 0, F.col("id"))).alias("component_id"),
    )
