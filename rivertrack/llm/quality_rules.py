"""Quality rules whose cutoffs come from the data: mergeable quantile sketches per language and
source take the place of fixed thresholds. Built-in DataFrame functions only.

A sketch is a histogram on a grid with 32 steps per power of two (`bucket`), one row per group,
measure and bucket. Two sketches merge by adding counts, so tasks sketch what they read, the
shuffle carries buckets instead of documents, and a hot source is no more than its buckets. Any
quantile read from it is off by at most 1/32 of its value. Unlike sampling sketches it does not
depend on the order of rows: a task that runs again gives the same cutoffs.
"""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from rivertrack.llm.common import WORD_GAP, let, whole_text, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# Measure -> least spread, in thousandths: the fence never comes nearer to the upper quartile
# than SPREADS times this, so groups without any spread do not reject their first odd document.
MEASURES = {"symbols": 100, "repeats": 100, "dup_lines": 150, "capitals": 100, "word_length": 1000}
SPREADS = 3
MIN_GROUP = 100  # smaller groups use the sketch of their language, or of all documents
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(words):
    """Words in 3-word windows found twice or more. Windows are compared by a 64-bit hash; only
    a text with an equal pair is sorted, by hash and place, to see where they are."""

    def positions(w):
        spots = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(
                F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"),
                i.alias("at"),
            ),
        )
        return let(spots, lambda s: F.when(_all_differ(s), F.lit(0)).otherwise(_covered(s)))

    def _all_differ(spots):
        hashes = F.transform(spots, lambda x: x["h"])
        return F.size(F.array_distinct(hashes)) == F.size(spots)

    def _covered(spots):
        def twice(s):
            return F.filter(
                s,
                lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
            )

        spread = F.transform(
            let(F.sort_array(spots), twice),
            lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2),
        )
        return F.size(F.array_distinct(F.flatten(spread)))

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(positions(words))


def measured(docs, text="text", keep=()):
    """One row per row of ``docs``: the columns ``keep``, the counts of the base rules and the
    measures in thousandths. A null text has no words and all its measures are 0."""
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = F.array_remove(F.split("_text", WORD_GAP), "")
    of_words = let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeat_words(w).cast("long").alias("n_repeat_words"),
    ))
    of_lines = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("_n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ))
    base = docs.select(*keep, whole_text(text).alias("_text")).select(
        *keep,
        of_words.alias("_w"),
        of_lines.alias("_l"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("_text", F.lit(r"\p{Lu}")).cast("long").alias("_caps"),
    )
    base = base.select(
        *keep, "_w.n_words", "_w.word_chars", "n_symbols", "_l.n_dup_lines", "_w.n_repeat_words",
        "_l._n_lines", "_caps",
    )

    def per_mille(a, b):
        return F.when(F.col(b) > 0, F.expr(f"({a} * 1000L) div {b}")).otherwise(F.lit(0))

    return base.withColumns({
        "m_symbols": per_mille("n_symbols", "n_words"),
        "m_repeats": per_mille("n_repeat_words", "n_words"),
        "m_dup_lines": per_mille("n_dup_lines", "_n_lines"),
        "m_capitals": per_mille("_caps", "word_chars"),
        "m_word_length": per_mille("word_chars", "n_words"),
    }).drop("_n_lines", "_caps")


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )


def bucket(value):
    """The grid point at or below a whole number >= 0: five bits after the leading one stay."""
    low = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", F.col(value), low), low)


def sketches(rows, by=("lang", "source")):
    """Rows (level, *by, measure, bucket, n): the sketch of every group, and merged from them
    those of the first column of ``by`` (level 1) and of all rows (level 2). Null is a group."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), bucket(f"m_{m}").alias("bucket")) for m in MEASURES
    ]))
    cells = rows.select(*by, pairs.alias("_p")).select(*by, "_p.measure", "_p.bucket")
    groups = cells.groupBy(*by, "measure", "bucket").agg(F.count(F.lit(1)).alias("n"))
    groups = written(groups, "quality-sketch")
    null = F.lit(None).cast("string")

    def merged(level, keys):
        part = groups.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
        rest = {c: null for c in by if c not in keys}
        return part.withColumns(rest | {"level": F.lit(level)}).select(
            "level", *by, "measure", "bucket", "n"
        )

    parts = [merged(len(by) - k, by[:k]) for k in range(len(by), -1, -1)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def fences(sketch, by=("lang", "source")):
    """Rows (level, *by, n, f_<measure>): upper quartile plus SPREADS times the quartile range.
    A group's window holds its buckets only, at most a few hundred, not its documents."""
    group = ["level", *by, "measure"]
    run = Window.partitionBy(*group).orderBy("bucket")
    ranked = sketch.withColumn("_upto", F.sum("n").over(run)).withColumn(
        "_all", F.sum("n").over(Window.partitionBy(*group))
    )

    def quantile(percent):
        reached = 100 * F.col("_upto") >= percent * F.col("_all")
        return F.min(F.when(reached, F.col("bucket")))

    quartiles = ranked.groupBy(*group).agg(
        quantile(25).alias("q1"), quantile(75).alias("q3"), F.first("_all").alias("n")
    )
    least = F.element_at(
        F.create_map(*[F.lit(x) for m, v in MEASURES.items() for x in (m, v)]), F.col("measure")
    )
    fence = F.col("q3") + SPREADS * F.greatest(F.col("q3") - F.col("q1"), least)
    return quartiles.groupBy("level", *by).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("measure") == m, fence)).alias(f"f_{m}") for m in MEASURES],
    )


def cutoffs(rows, by=("lang", "source"), min_group=MIN_GROUP):
    """One row per group of ``by``: its fences, or those of the next larger group while it has
    fewer than ``min_group`` documents. Written, so that Spark knows its size when joining."""
    found = written(fences(sketches(rows, by), by), "quality-fences")
    names = [f"f_{m}" for m in MEASURES]
    out = found.filter("level = 0").select(*by, F.struct("n", *names).alias("_0"))
    for level in range(1, len(by)):
        keys = list(by[: len(by) - level])
        part = found.filter(F.col("level") == level).select(
            *[F.col(k).alias(f"_{k}") for k in keys], F.struct("n", *names).alias(f"_{level}")
        )
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        out = out.join(part, same, "left").drop(*[f"_{k}" for k in keys])
    # the sketch of all documents gives one row
    overall = found.filter(F.col("level") == len(by)).select(*names).first() or [None] * len(names)
    last = F.struct(F.lit(None).cast("long").alias("n"), *[
        F.lit(v).cast("long").alias(n) for n, v in zip(names, overall, strict=True)
    ])
    chosen = F.coalesce(
        *[F.when(F.col(f"_{i}.n") >= min_group, F.col(f"_{i}")) for i in range(len(by))], last
    )
    return written(out.select(*by, chosen.alias("_c")).select(*by, *[f"_c.{n}" for n in names]), "quality-cutoffs")


def judged(rows, limits, by=("lang", "source")):
    """``rows`` of `measured` with base_failed and kept. The join with the cutoffs carries no
    hint: their file size decides whether Spark broadcasts them, otherwise a hot group's rows
    are split at run time."""
    renamed = limits.withColumnsRenamed({k: f"_{k}" for k in by})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by])
    inside = reduce(lambda a, b: a & b, [F.col(f"m_{m}") <= F.col(f"f_{m}") for m in MEASURES])
    return (
        rows.join(renamed, same, "left")
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))
        .drop(*[f"_{k}" for k in by])
    )


def quality_verdicts(docs, id_col="doc_id", text="text", by=("lang", "source")):
    """One row per row of ``docs``: the id, the base counts, the measures, base_failed, kept.

    Nulls: a null text has no words and fails the base rules; null language or source is a group
    of its own. Equal rows get equal verdicts. An empty table gives an empty result. Other
    columns of ``docs`` are not read."""
    rows = written(measured(docs, text, keep=(id_col, *by)), "quality-measures")
    return judged(rows, cutoffs(rows, by), by)


MOST_BROADCAST = 500_000  # rejected texts, some 60 bytes each


def quality_filter(docs, text="text", by=("lang", "source")):
    """The rows of ``docs`` that the rules keep, with all their columns and only those. A verdict
    depends on the text and its group alone, so measures are written once beside the text's hash,
    and what is rejected is known by hash and group: broadcast if it is little (counted), else
    joined by a shuffle. Each row travels as one struct, so that no name can clash."""
    digest = F.md5(whole_text(text))
    rows = measured(docs.select(*by, text, digest.alias("_hash")), text, keep=(*by, "_hash"))
    rows = written(rows, "quality-measures")
    out = judged(rows, cutoffs(rows, by), by).filter("not kept").select(*by, "_hash").distinct()
    out = written(out, "quality-rejected")
    few = out.count() <= MOST_BROADCAST
    named = out.toDF(*[f"no_{i}" for i in range(len(by))], "no_hash")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    mine = docs.select(
        whole.alias("row"), *[F.col(c).alias(f"by_{i}") for i, c in enumerate(by)], digest.alias("hash")
    )
    same = F.col("hash") == F.col("no_hash")
    for i in range(len(by)):
        same = same & F.col(f"by_{i}").eqNullSafe(F.col(f"no_{i}"))
    return mine.join(F.broadcast(named) if few else named, same, "left_anti").select("row.*")
