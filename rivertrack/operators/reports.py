"""Counts, rates and summaries. Anything "per distinct tag" is first reduced to one row per tag
(combined map-side) and then counted, so no row is expanded and no tag is counted twice."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivertrack import constants as K
from rivertrack.operators.lookups import after_tagging, first_match, sex_label
from rivertrack.schema import fixed_table
from rivertrack.sources.files import stage_path, write_stage


def _count() -> Column:
    return F.count(F.lit(1))


def count_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(_count().alias(name))


# of the sketch that brackets a median: its size, how far from the middle the bracket reaches (some
# eight times its usual error) and into how many parts the bracket is cut
SKETCH_SIZE, SKETCH_REACH, BRACKET_PARTS = 2048, 0.004, 64


def length_summary(tags: DataFrame, group: str = "sex", value: str = "fork_length") -> DataFrame:
    """n, mean, exact median, min, max and sd of ``value`` per group, NULLs left out but for n.

    The median takes two scans and no sorted group. The first one makes a sketch of each group
    beside the other figures, whose quantiles bracket the middle rank; the second counts the values
    below the bracket and, part by part, the few inside it, and only the part that holds the middle
    rank is put in order. Should a sketch ever be so far off that its bracket misses the middle,
    the run ends; a wrong median is never returned. NaN counts as larger than any number.
    """
    x = F.col(value)
    number = x.cast("double")
    infinity = F.lit(float("inf"))
    stats = tags.groupBy(group).agg(
        _count().alias("n"),
        F.avg(x).alias("mean"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.stddev_samp(x).alias("sd"),
        F.count(x).alias("_m"),
        F.kll_sketch_agg_double(F.nanvl(number, infinity), F.lit(SKETCH_SIZE)).alias("_sketch"),
    )
    # one row per group, needed twice; the median is the mean of the values at both ranks
    stats = write_stage(stats, stage_path(tags.sparkSession, "length-stats")).withColumns(
        {"_r1": F.floor((F.col("_m") + 1) / 2), "_r2": F.floor((F.col("_m") + 2) / 2)}
    )
    step = 2 * SKETCH_REACH / BRACKET_PARTS
    at = F.array(*[F.lit(0.5 - SKETCH_REACH + i * step) for i in range(BRACKET_PARTS + 1)])
    brackets = stats.where(F.col("_m") > 0).select(
        F.col(group).alias("_g"), "_r1", "_r2", F.kll_sketch_get_quantile_double("_sketch", at).alias("_cuts")
    )
    cuts, place = F.col("_cuts"), F.nanvl("_x", infinity)
    below = place < cuts[0]
    part = F.size(F.filter(cuts, lambda c: c < place))
    counts = (
        tags.select(F.col(group).alias("_h"), number.alias("_x"))
        .join(brackets, F.col("_h").eqNullSafe(F.col("_g")))
        .where(place <= cuts[BRACKET_PARTS])
        .withColumns({"_part": F.when(below, -1).otherwise(part), "_x": F.when(~below, F.col("_x"))})
        .groupBy("_g", "_r1", "_r2", "_part", "_x")
        .agg(_count().alias("_c"))
    )
    # what lies inside is a small share of the rows, and it is needed twice
    counts = write_stage(counts, stage_path(tags.sparkSession, "length-bracket"))
    per_part = counts.groupBy("_g", "_r1", "_r2", "_part").agg(F.sum("_c").alias("_pc"))
    upto = Window.partitionBy("_g").orderBy("_part")
    middle = (
        per_part.withColumn("_end", F.sum("_pc").over(upto))
        .withColumn("_before", F.col("_end") - F.col("_pc"))
        .where((F.col("_before") < F.col("_r2")) & (F.col("_end") >= F.col("_r1")) & (F.col("_part") >= 0))
        .select(F.col("_g").alias("_k"), F.col("_part").alias("_p"), "_before")
    )
    in_part = Window.partitionBy("_g", "_part").orderBy("_x")
    ranked = (
        counts.join(
            middle, F.col("_g").eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p"))
        )
        .withColumn("_end", F.col("_before") + F.sum("_c").over(in_part))
        .withColumn("_start", F.col("_end") - F.col("_c"))
    )

    def at_rank(rank):
        return F.max(F.when((F.col("_start") < F.col(rank)) & (F.col("_end") >= F.col(rank)), F.col("_x")))

    median = ranked.groupBy("_g").agg(((at_rank("_r1") + at_rank("_r2")) / 2).alias("_median"))
    missed = F.raise_error(F.lit("the sketch missed the median; run again")).cast("double")
    exact = F.when(F.col("_m") > 0, F.coalesce("_median", missed))
    return stats.join(median, F.col(group).eqNullSafe(F.col("_g")), "left").select(
        group, "n", "mean", exact.alias("median"), "min", "max", "sd"
    )


def length_histogram(
    tags: DataFrame,
    group: str = "sex",
    value: str = "fork_length",
    width: float = K.HISTOGRAM_BIN,
    limits: tuple[float, float] | None = K.HISTOGRAM_RANGE,
    centre: float = 0.0,
) -> DataFrame:
    """Counts per group and bin; bins are right-closed, one of them centred on ``centre``. Values
    outside ``limits`` are left out; empty bins have no row."""
    x = F.col(value)
    rows = tags.where(x.between(*limits)) if limits else tags.where(x.isNotNull())
    middle = (F.ceil((x - centre) / width - 0.5) * F.lit(width) + centre).cast("double")
    return rows.groupBy(sex_label(group).alias(group), middle.alias("bin")).agg(
        _count().alias("n")
    )


def false_positive_rate(det: DataFrame, tags: DataFrame) -> DataFrame:
    """Per station: raw rows, rows kept by the tag join and the tagging time, share removed."""
    raw = count_by(det, "station", name="raw")
    kept = count_by(after_tagging(det, tags), "station", name="kept")
    kept_or_0 = F.coalesce("kept", F.lit(0))
    return raw.join(kept, "station", "left").select(
        "station",
        "raw",
        kept_or_0.alias("kept"),
        (1 - kept_or_0 / F.col("raw")).alias("false_positive_rate"),
    )


def tag_flags(det: DataFrame, conditions: dict[str, Column], **more: Column) -> DataFrame:
    """One row per tag: did any of its rows meet each condition? ``more`` are further
    aggregates."""
    return det.groupBy("tag").agg(
        *[F.coalesce(F.max(c), F.lit(False)).alias(n) for n, c in conditions.items()],
        *[c.alias(n) for n, c in more.items()],
    )


def detected_conditions(fixed=K.FIXED_STATIONS, mobile: str = "Mobile") -> dict[str, Column]:
    return {
        "any": F.col("station").isin(*fixed, mobile),
        "fixed": F.col("station").isin(*fixed),
        "mobile": F.col("station") == mobile,
    }


def count_detected(seen: DataFrame, tags: DataFrame) -> DataFrame:
    """``detected_counts`` from one row per tag with its flags."""
    known = tags.select("tag").distinct().join(seen, "tag", "left")
    counts = known.agg(
        _count().alias("tags"), *[F.count_if(F.col(c)).alias(c) for c in ("any", "fixed", "mobile")]
    )
    return counts.withColumn("undetected", F.col("tags") - F.col("any"))


def detected_counts(
    det: DataFrame, tags: DataFrame, fixed=K.FIXED_STATIONS, mobile: str = "Mobile"
) -> DataFrame:
    """Tags, and how many were detected at all, at fixed stations, in mobile surveys, nowhere."""
    return count_detected(tag_flags(det, detected_conditions(fixed, mobile)), tags)


def undetected_tags(tags: DataFrame, det: DataFrame) -> DataFrame:
    """Tags without a single detection."""
    return tags.select("tag").distinct().join(det.select("tag").distinct(), "tag", "left_anti")


def efficiency_conditions(stations=tuple(K.EFFICIENCY_STATIONS)) -> dict[str, Column]:
    out = {}
    for name, rkm, zone in stations:
        inside = F.lit(True) if zone is None else F.col("zone") == zone
        out[f"at_{name}"] = (F.col("rkm") == rkm) & inside
        out[f"up_{name}"] = (F.col("rkm") >= rkm) & inside
    return out


def count_efficiency(flags: DataFrame, stations=tuple(K.EFFICIENCY_STATIONS)) -> DataFrame:
    """``detection_efficiency`` from one row per tag with its flags."""
    names = [n for n, _, _ in stations]
    totals = flags.agg(
        *[F.count_if(F.col(c)).alias(c) for n in names for c in (f"at_{n}", f"up_{n}")]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("station"),
                F.col(f"at_{n}").alias("at_station"),
                F.col(f"up_{n}").alias("at_or_upstream"),
            )
            for n in names
        ]
    )
    return totals.select(F.inline(rows)).withColumn(
        "efficiency", F.try_divide("at_station", "at_or_upstream") * 100
    )


def detection_efficiency(det: DataFrame, stations=tuple(K.EFFICIENCY_STATIONS)) -> DataFrame:
    """Per station: tags detected at it, tags at or upstream of it, percentage. One pass."""
    return count_efficiency(tag_flags(det, efficiency_conditions(stations)), stations)


def sex_number(sex="sex") -> Column:
    """A number, so that an aggregation over it hashes instead of sorting."""
    label = sex_label(sex)
    return F.when(label == "Male", 2).when(label == "Female", 1).otherwise(0)


def count_presence(flags: DataFrame, sections) -> DataFrame:
    """``zone_presence_counts`` from one row per tag with its flags and ``sex`` as a number."""

    def counted(section):
        here = F.col(section)
        return F.struct(
            F.lit(section).alias("section"),
            F.count_if(here & (F.col("sex") == 2)).alias("male"),
            F.count_if(here & (F.col("sex") == 1)).alias("female"),
            F.count_if(here & (F.col("sex") == 0)).alias("unknown"),
            F.count_if(here).alias("total"),
        )

    # a section that no tag reached has a row of zeros
    return flags.agg(F.array(*[counted(n) for n in sections]).alias("_rows")).select(F.inline("_rows"))


def zone_presence_counts(det: DataFrame, sections: dict[str, Column]) -> DataFrame:
    """Tags ever present in each section, by sex. A tag may count in several sections."""
    return count_presence(tag_flags(det, sections, sex=F.max(sex_number())), sections)


def multi_survey_tags(det: DataFrame, surveys: int = 3, station: str = "Mobile") -> DataFrame:
    """Tags seen on at least ``surveys`` mobile survey days: days with a row of the surveys'
    ``station``, whatever the cascade has made of its method since."""
    return (
        det.where(F.col("station") == station)
        .groupBy("tag")
        .agg(F.count_distinct("date").alias("surveys"))
        .where(F.col("surveys") >= surveys)
    )


def tag_pages(det: DataFrame, per_page: int = K.PANELS_PER_PAGE) -> DataFrame:
    """Distinct tags in sorted order with their ``page`` and ``panel``.

    Tags are dealt out by range and sorted within each; the rank over all of them is the place in
    the range plus the tags of the ranges before. They are written as they lie, so that a task
    run again cannot draw other ranges; one count per range reaches the driver."""
    spark = det.sparkSession
    tags = det.select("tag").where(F.col("tag").isNotNull()).distinct()
    ranged = tags.repartitionByRange("tag").sortWithinPartitions("tag")
    # the id has the partition in its upper bits and the place within it in the lower 33
    placed = ranged.withColumn("_id", F.monotonically_increasing_id())
    placed = write_stage(placed, stage_path(spark, "tags-in-order"))
    sizes = placed.groupBy(F.shiftright("_id", 33).alias("_range")).agg(_count().alias("n"))
    before, table = 0, []
    for r in sorted(sizes.collect()):
        table.append((r._range, before))
        before += r.n
    earlier = F.broadcast(fixed_table(spark, table, "_range BIGINT, _before BIGINT"))
    rank = F.col("_id").bitwiseAND(2**33 - 1) + F.col("_before")
    return (
        placed.withColumn("_range", F.shiftright("_id", 33))
        .join(earlier, "_range")
        .select(
            "tag",
            (F.floor(rank / per_page) + 1).alias("page"),
            (rank % per_page + 1).alias("panel"),
        )
    )


def history_panel(
    det: DataFrame,
    locations: Column,
    lake: tuple[str, float] = (K.LAKE_ZONE, K.LAKE_RKM),
    rkm_range: tuple[float, float] = K.PANEL_RKM_RANGE,
    per_page: int = K.PANELS_PER_PAGE,
) -> DataFrame:
    """Detection-history rows by page and panel. Detections in the lake are drawn at one rkm;
    rows outside the axis are left out after the panels are laid out."""
    rkm = F.when(F.col("zone") == lake[0], F.lit(lake[1])).otherwise(F.col("rkm"))
    rows = det.select("tag", "ts", "seq", rkm.alias("rkm"), "method", "zone").withColumn(
        "location", locations
    )
    return rows.where(F.col("rkm").between(*rkm_range)).join(tag_pages(det, per_page), "tag")


def study_locations() -> Column:
    """Location label of the study: the fallback station first, then the zone; NULL for a zone
    that is not on the list."""
    cases = [(F.col("rkm") == K.FALLBACK_RKM, "Fallback")]
    return first_match(cases + [(F.col("zone") == z, label) for z, label in K.HISTORY_LOCATIONS])
