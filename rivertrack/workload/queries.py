"""One query per operator, on the given tables in their telemetry roles. Dates leave as text;
everything else as the operators return it."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivertrack import constants as K
from rivertrack.functions.keys import normalise_key, pad_two_digit_code, tag_key
from rivertrack.functions.times import parse_date, parse_ts
from rivertrack.operators import arrivals, cleaning, lookups, reports, rules, spatial, speed
from rivertrack.operators.timeline import cluster
from rivertrack.plans import cascade, fixed, maps, mobile, movement
from rivertrack.schema import fixed_table
from rivertrack.sources import files, receivers
from rivertrack.workload import binding as B
from rivertrack.workload.binding import Z1, Z2

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__.removesuffix("_")] = fn
    return fn


def _day(name="date"):
    return F.col(name).cast("string").alias(name)


def _after_tagging(spark, sf):
    """For aggregations per tag: the join with the tag table is salted for very long tags, as
    otherwise the aggregation would take over the join's partitions, skew and all."""
    return lookups.after_tagging(B.timelines(spark, sf), B.tags(spark, sf))


# --- joins with the tag table --------------------------------------------------------------


@query
def detection_tag_join(spark, sf):
    det = lookups.detection_tag_join(B.detections(spark, sf), B.tags(spark, sf))
    return det.select("tag", "ts", "seq", "station", "sex", "fork_length", "tag_ts")


@query
def after_tagging(spark, sf):
    det = lookups.after_tagging(B.detections(spark, sf), B.tags(spark, sf))
    return det.select("tag", "ts", "seq", "station", "tag_ts")


@query
def undetected_tags(spark, sf):
    return reports.undetected_tags(B.tags(spark, sf), B.detections(spark, sf))


# --- timeline operators --------------------------------------------------------------------


@query
def dedup_keep_first(spark, sf):
    hourly = B.detections(spark, sf).withColumn("hour", F.date_trunc("hour", "ts"))
    hourly = hourly.withColumn("hour", F.col("hour").cast("timestamp_ntz"))
    kept = cleaning.dedup_keep_first(hourly, by=("tag", "hour"))
    return kept.select("tag", "hour", "seq", "ts", "power")


@query
def detection_lag(spark, sf):
    return cleaning.detection_lag(B.timelines(spark, sf)).select("tag", "ts", "seq", "lag_s")


@query
def min_gap_filter(spark, sf):
    kept = cleaning.min_gap_filter(B.timelines(spark, sf), B.MIN_GAP)
    return kept.select("tag", "ts", "seq", "lag_s")


@query
def lost_tag_flag(spark, sf):
    flagged = cleaning.lost_tag_flag(B.timelines(spark, sf), B.LOST_GAP, B.LOST_TOLERANCE)
    return flagged.select("tag", "ts", "seq", "method")


@query
def lost_tags(spark, sf):
    return cleaning.lost_tags(B.timelines(spark, sf), B.LOST_GAP, B.LOST_TOLERANCE)


@query
def movement_rates(spark, sf):
    moves = cleaning.movement_rates(B.timelines(spark, sf))
    return moves.select("tag", "ts", "seq", "rkm", "distance", "lag_days", "rate")


@query
def impossible_moves(spark, sf):
    moves = cleaning.impossible_moves(B.timelines(spark, sf), B.MAX_DISTANCE, B.MAX_RATE)
    return moves.select("tag", "ts", "seq", "rkm", "distance", "lag_days")


@query
def speed_filter_fixpoint(spark, sf):
    kept = speed.speed_filter(
        B.timelines(spark, sf).drop("power", "date", "zone", "station", "method"),
        B.MAX_DISTANCE,
        B.MAX_RATE,
    )
    return kept.select("tag", "ts", "seq", "rkm")


@query
def terminal_zone_lock(spark, sf):
    out = cleaning.terminal_zone_lock(B.timelines(spark, sf), Z1)
    return cleaning.terminal_zone_lock(out, Z2).select("tag", "ts", "seq", "zone")


@query
def reach_flag_cumsum(spark, sf):
    out = cleaning.reach_flag_cumsum(B.timelines(spark, sf), Z1)
    return out.select("tag", "ts", "seq", "zone", "flag", "reached")


# (tag, station, rkm, methods, from, to)
TEST_RULES = [
    (1, None, None, None, None, None),
    (2, "3", None, None, None, None),
    (3, None, 42.0, None, None, None),
    (5, None, None, ["Fixed", "Mobile"], "2024-01-10 00:00:00", None),
    (8, None, None, ["Mobile"], None, None),
    (13, "1", None, None, None, "2024-01-20 12:00:00"),
    (21, None, None, None, "2024-01-05 00:00:00", "2024-01-15 00:00:00"),
    (34, "4", None, ["Fixed"], "2024-01-12 06:30:00", "2024-01-25 00:00:00"),
    (55, "2", None, None, "2024-01-02 00:00:00", None),
    (89, None, None, ["Fixed"], None, "2024-01-28 00:00:00"),
    (144, None, None, None, "2024-01-20 00:00:00", None),
    (144, None, None, None, None, "2024-01-03 00:00:00"),
]


def _rules(spark, tag_type="BIGINT"):
    table = fixed_table(
        spark,
        TEST_RULES,
        "tag BIGINT, station STRING, rkm DOUBLE, methods ARRAY<STRING>, f STRING, t STRING",
    )
    return table.select(
        F.col("tag").cast(tag_type).alias("tag"),
        "station",
        "rkm",
        "methods",
        parse_ts("f").alias("ts_from"),
        parse_ts("t").alias("ts_to"),
    )


@query
def exclusion_rules(spark, sf):
    kept = rules.exclude(B.detections(spark, sf), _rules(spark))
    return kept.select("tag", "ts", "seq", "station", "rkm", "method")


@query
def rules_by_time(spark, sf):
    """Each survey row of a tag rules out its fixed rows of the six hours that follow."""
    det = B.detections(spark, sf)
    after = det.where(F.col("method") == "Mobile").select(
        "tag",
        F.lit(None).cast("string").alias("station"),
        F.lit(None).cast("double").alias("rkm"),
        F.array(F.lit("Fixed")).alias("methods"),
        F.col("ts").alias("ts_from"),
        F.expr("ts + interval 6 hours").alias("ts_to"),
    )
    kept = rules.exclude_by_time(det, after.unionByName(_rules(spark)))
    return kept.select("tag", "ts", "seq", "station", "rkm", "method")


@query
def study_rules(spark, sf):
    """The study's own rules over detections under the keys that they name, in their season."""
    shipped = rules.study_rules(spark)
    keys = sorted({r.tag for r in shipped.select("tag").collect()})
    named = F.element_at(F.lit(keys), (F.col("tag") % len(keys) + 1).cast("int"))
    # three days of a season for each day, and the study's places
    ts = F.expr("timestamp_ntz'2023-07-04 00:00:00' + 3 * (ts - timestamp_ntz'2024-01-01 00:00:00')")
    rkm, mobile = F.col("rkm"), F.col("method") == "Mobile"
    place = F.when(rkm < 40, -0.7).when(rkm < 60, 42.0).when(rkm < 80, 214.0).otherwise(rkm)
    det = B.detections(spark, sf).withColumns(
        {"tag": named, "ts": ts, "rkm": place, "station": F.when(mobile, "Mobile").otherwise(F.col("station"))}
    )
    return rules.exclude(det, shipped).select("tag", "ts", "seq", "station", "rkm", "method")


@query
def max_power_per_day(spark, sf):
    kept = cleaning.strongest_mobile(B.detections(spark, sf))
    return kept.select("tag", "ts", "seq", "method", "power")


# --- arrivals ------------------------------------------------------------------------------

TARGETS = (
    ("fallback", "station", "1", "hours"),
    ("click", "station", "2", "days"),
    ("error", "zone", "error", "days"),
    ("signup", "zone", "signup", "days"),
    ("purchase", "zone", "purchase", "days"),
)


@query
def first_arrival(spark, sf):
    out = arrivals.first_arrival(_after_tagging(spark, sf), F.col("zone") == Z1, "zone", "hours")
    return out.select("tag", "sex", _day("zone_date"), "zone_hours", "station", "tag_ts")


def _summary(spark, sf):
    return arrivals.arrival_summary(_after_tagging(spark, sf), B.tags(spark, sf), TARGETS)


@query
def arrival_summary(spark, sf):
    out = _summary(spark, sf)
    return out.select(*[_day(c) if c.endswith("_date") else F.col(c) for c in out.columns])


@query
def arrival_timing_stats(spark, sf):
    out = arrivals.arrival_timing_stats(_summary(spark, sf), TARGETS)
    return out.select(*[_day(c) if c.endswith("_date") else F.col(c) for c in out.columns])


@query
def last_detection(spark, sf):
    return arrivals.last_detection(B.detections(spark, sf)).select("tag", "ts", "seq", "zone")


@query
def last_detection_ties(spark, sf):
    out = arrivals.last_detection_ties(B.detections(spark, sf), by="date")
    return out.select("tag", "ts", "seq", _day())


SECTIONS = {
    "upper": ("view", 60.0),
    "lake": ("error", 0.0),
    "left_arm": ("signup", 30.0),
    "right_arm": ("purchase", 50.0),
}


def _sections():
    return {
        name: (F.col("zone") == zone) & (F.col("rkm") >= rkm)
        for name, (zone, rkm) in SECTIONS.items()
    }


@query
def priority_union(spark, sf):
    det = _after_tagging(spark, sf)
    where = _sections()
    system = where["lake"] | where["left_arm"] | where["right_arm"]
    out = arrivals.priority_union(
        [
            ("upper", arrivals.first_per_tag(det.where(where["upper"])).drop("power")),
            ("system", arrivals.last_detection_ties(det.where(system))),
            ("left_arm", arrivals.first_per_tag(det.where(where["left_arm"]))),
            ("right_arm", arrivals.first_per_tag(det.where(where["right_arm"]))),
        ]
    )
    return out.select("tag", "source", "ts", "seq", "zone", "sex", "power")


@query
def spawner_fate(spark, sf):
    """Surveys reach the upper river on few rows and all spawning waters on the others."""
    det = _after_tagging(spark, sf)
    mobile, at = F.col("method") == "Mobile", F.col("at")
    waters = lookups.first_match(
        [(at >= 97, "Upper Bulkley River"), (at < 30, "Atna River"), (at < 60, "Nanika River")]
    )
    det = det.withColumnsRenamed({"rkm": "at"}).drop("zone")
    det = lookups.station_lookup(det.withColumn("tag", B.key_of(F.col("tag")))).withColumns(
        {
            "station": F.when(mobile, "Mobile").otherwise(F.col("station")),
            "zone": F.when(mobile, F.coalesce(waters, F.lit("Morice Lake"))).otherwise(F.col("zone")),
        }
    )
    return movement.spawner_fate(det).select("tag", "source", "ts", "seq", "station", "zone")


EFFICIENCY = (("20", 20.0, None), ("40", 40.0, None), ("60", 60.0, "signup"), ("80", 80.0, Z1))


@query
def movement_facts(spark, sf):
    """All that the movement report says of a tag, from a table clustered by tag."""
    det = cluster(_after_tagging(spark, sf), files.stage_path(spark, "after-tagging"))
    where = _sections()
    system = where["lake"] | where["left_arm"] | where["right_arm"]
    facts = movement.tag_facts(
        det,
        TARGETS,
        EFFICIENCY,
        where,
        [
            ("upper", where["upper"], "first"),
            ("system", system, "last"),
            ("left_arm", where["left_arm"], "first"),
            ("right_arm", where["right_arm"], "first"),
        ],
        detected=("1", "2", "3", "4", "5"),
        survey_station="3",
    )
    fate = {"fate_source": "fate.source", "fate_ts": "fate.row.ts", "fate_seq": "fate.seq"}
    facts = facts.withColumns({name: F.col(c) for name, c in fate.items()})
    return facts.drop("any", "fixed", "mobile", "fate")


# --- unions, lookups, keys -----------------------------------------------------------------


@query
def unified_timeline(spark, sf):
    det, tag_table = B.detections(spark, sf), B.tags(spark, sf)
    rows = lookups.detection_tag_join(det, tag_table)
    out = cascade.unified_timeline(
        rows.where(F.col("method") == "Fixed"), rows.where(F.col("method") == "Mobile"), tag_table
    )
    return out.select(
        "tag", _day(), "ts", "power", "zone", "rkm", "method", "station", "tag_ts", "sex",
        "fork_length", "seq",
    )


@query
def zone_assignment(spark, sf):
    rkm, zone = F.col("rkm"), F.col("zone")
    reach = lookups.first_match(
        [
            (rkm < 10, "Fallback"),
            ((rkm < 40) & (zone == "view"), "Lower river"),
            (zone == "signup", "Left arm"),
            ((zone == "purchase") & (rkm >= 50), "Right arm"),
            (rkm.between(60, 80), "Lake"),
        ]
    )
    return B.detections(spark, sf).select("tag", "seq", "rkm", "zone", reach.alias("reach"))


@query
def station_lookup(spark, sf):
    det = B.detections(spark, sf).drop("zone", "rkm")
    out = lookups.station_lookup(det)
    return out.select("tag", "seq", "station", "zone", "rkm", "lat", "long")


@query
def channel_to_freq(spark, sf):
    det = B.detections(spark, sf).withColumn("channel", F.col("station").cast("int"))
    return lookups.channel_frequency(det).select("tag", "seq", "channel", "frequency")


@query
def tag_key_(spark, sf):
    det = B.detections(spark, sf)
    freq = B.frequency(F.col("tag")).cast("decimal(6,3)")
    known = F.when(F.col("rkm") != 50, F.col("tag"))
    return det.select("seq", tag_key(freq, known).alias("key"))


@query
def tag_key_normalise(spark, sf):
    det = B.detections(spark, sf)
    number = F.col("tag") % 120
    written = F.concat_ws(
        " ",
        F.when(number % 2 == 0, "149.5").otherwise("149.32"),
        F.when(F.col("rkm") == 3, "3?").otherwise(number.cast("string")),
    )
    return det.select(
        "seq",
        written.alias("written"),
        normalise_key(written).alias("key"),
        pad_two_digit_code(written).alias("padded"),
    )


@query
def parse_timestamps(spark, sf):
    det = B.detections(spark, sf)
    bad = F.col("rkm") < 5
    iso = F.when(bad, "unknown").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    us = F.when(bad, "13/45/2024").otherwise(F.date_format("ts", "MM/dd/yyyy"))
    clock = F.date_format("ts", "HH:mm:ss")
    return det.select(
        "seq",
        parse_date(iso).cast("string").alias("iso_day"),
        parse_date(us, "M/d/yyyy").cast("string").alias("us_day"),
        parse_ts(F.concat_ws(" ", iso, clock)).alias("at"),
        F.hour(parse_ts(F.concat_ws(" ", iso, clock))).cast("bigint").alias("hour"),
        parse_ts(F.concat_ws(" ", iso, F.date_format("ts", "HH:mm")), "yyyy-MM-dd HH:mm").alias(
            "at_minute"
        ),
    )


@query
def metadata_overrides(spark, sf):
    raw = B.table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("code"),
        F.when(F.col("o_orderpriority") != "1-URGENT", "500").alias("freq"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("date").cast("string"))
        .alias("date"),
        F.col("o_orderkey").alias("seq"),
    )
    patched = lookups.metadata_overrides(raw)
    freq = F.concat(F.lit("149."), "freq").try_cast("decimal(6,3)")
    keyed = patched.withColumn("tag", tag_key(freq, F.col("code").try_cast("int")))
    usable = keyed.where(F.col("tag").isNotNull() & F.col("date").isNotNull())
    return cleaning.dedup_keep_first(usable, by=("tag",)).select("tag", "date", "seq")


@query
def exclude_test_tags(spark, sf):
    det = B.keyed_detections(spark, sf)
    kept = lookups.exclude_test_tags(det, (*K.TEST_TAGS, "149.500 012", "149.320 011"))
    return kept.select("tag", "ts", "seq")


@query
def reject_error_records(spark, sf):
    code = (
        F.when(F.col("rkm") == 13, "999")
        .when(F.col("rkm") == 77, "of")
        .otherwise(F.col("tag").cast("string"))
    )
    det = B.detections(spark, sf).withColumn("code", code)
    good, rejected = lookups.reject_error_records(det)
    return good.withColumn("ok", F.lit(True)).unionByName(
        rejected.withColumn("ok", F.lit(False))
    ).select("seq", "code", "ok")


# --- summaries -----------------------------------------------------------------------------


@query
def length_summary(spark, sf):
    out = reports.length_summary(B.tags(spark, sf))
    return out.select(
        "sex", "n", *[F.round(c, 4).alias(c) for c in ("mean", "median", "min", "max", "sd")]
    )


@query
def length_histogram(spark, sf):
    return reports.length_histogram(B.tags(spark, sf), width=1000.0, limits=(-500.0, 9500.0))


@query
def detections_per_station(spark, sf):
    return reports.count_by(B.detections(spark, sf), "station")


@query
def freqs_per_survey(spark, sf):
    det = B.detections(spark, sf).where(F.col("method") == "Mobile")
    det = det.withColumn("freq", B.frequency(F.col("tag")))
    return reports.count_by(det, "date", "freq").select(_day(), "freq", "n")


@query
def false_positive_rate(spark, sf):
    out = reports.false_positive_rate(B.detections(spark, sf), B.tags(spark, sf))
    return out.withColumn("false_positive_rate", F.round("false_positive_rate", 6))


@query
def detected_counts(spark, sf):
    det = _after_tagging(spark, sf)
    det = det.withColumn(
        "station", F.when(F.col("method") == "Mobile", "Mobile").otherwise(F.col("station"))
    )
    return reports.detected_counts(det, B.tags(spark, sf))


@query
def zone_presence_counts(spark, sf):
    return reports.zone_presence_counts(_after_tagging(spark, sf), _sections())


@query
def multi_survey_tags(spark, sf):
    return reports.multi_survey_tags(B.detections(spark, sf), 3, station="3")


@query
def detection_efficiency(spark, sf):
    out = reports.detection_efficiency(B.detections(spark, sf), EFFICIENCY)
    return out.withColumn("efficiency", F.round("efficiency", 6))


# --- positions -----------------------------------------------------------------------------


@query
def project_utm(spark, sf):
    points = B.embedding_points(spark, sf)
    placed = points.select(
        "det_id", (-127.0 + F.col("x")).alias("long"), (54.5 + F.col("y")).alias("lat")
    )
    out = spatial.project_utm(placed)
    return out.select("det_id", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


@query
def nearest_reference_point(spark, sf):
    points = B.embedding_points(spark, sf)
    out = spatial.nearest_reference_point(points, B.label_points(points))
    return out.select("det_id", "idx", "zone_label", F.round("dist", 6).alias("dist"))


@query
def layer_points(spark, sf):
    """The reference points as a layer of files, larger than a task may hold."""
    points = B.label_points(B.embedding_points(spark, sf))
    path = files.stage_path(spark, "layer")
    files.write_stage(points, path)
    placed = B.embedding_points(spark, sf).drop("label")
    out = spatial.nearest_reference_point(placed, files.read_layer(spark, path), max_points=3, per_leaf=4)
    return out.select("det_id", "idx", "zone_label", F.round("dist", 6).alias("dist"))


@query
def survey_slice(spark, sf):
    out = spatial.survey_slices(B.detections(spark, sf))
    return out.select("tag", "seq", _day(), F.col("survey").cast("bigint").alias("survey"), "rkm")


EXTENTS = (
    ("all", -1.0, 1.0, -1.0, 1.0),
    ("centre", -0.05, 0.05, -0.05, 0.05),
    ("north", -0.2, 0.2, 0.05, 0.4),
    ("south west", -0.4, 0.0, -0.4, 0.0),
)


@query
def bbox_membership(spark, sf):
    points = B.embedding_points(spark, sf)
    return spatial.bbox_membership(points, EXTENTS).select("det_id", "x", "y", "extent")


@query
def extent_windows(spark, sf):
    """Each extent read by itself from points that lie by place."""
    points = spatial.write_by_place(
        B.embedding_points(spark, sf), files.stage_path(spark, "points"), EXTENTS
    )
    windows = [spatial.in_extent(points, name, EXTENTS) for name, *_ in EXTENTS]
    return reduce(DataFrame.unionByName, windows).select("det_id", "x", "y", "extent")


@query
def survey_map(spark, sf):
    slices = spatial.survey_slices(B.positions(B.detections(spark, sf)))
    out = spatial.bbox_membership(spatial.project_utm(slices))
    return out.select(
        "tag", "seq", F.col("survey").cast("bigint").alias("survey"), "extent",
        F.round("x", 2).alias("x"), F.round("y", 2).alias("y"),
    )


# ten survey days, one of them jittered otherwise
SURVEY_DAYS = tuple(f"2024-01-{d:02}" for d in (2, 4, 5, 9, 11, 12, 18, 19, 23, 30))
JITTERS = {"2024-01-18": 2000.0}


@query
def survey_map_jitter(spark, sf):
    det = B.positions(B.detections(spark, sf))
    out = maps.survey_maps(det, SURVEY_DAYS, by_day=JITTERS)
    return out.select(
        "tag", "seq", _day(), F.col("survey").cast("bigint").alias("survey"), "extent",
        F.round("x_jitter", 2).alias("x_jitter"), F.round("y_jitter", 2).alias("y_jitter"),
    )


@query
def last_detection_map(spark, sf):
    last = arrivals.last_detection(B.positions(B.detections(spark, sf)))
    out = spatial.bbox_membership(spatial.project_utm(last))
    return out.select(
        "tag", "seq", "extent", F.round("x", 2).alias("x"), F.round("y", 2).alias("y")
    )


@query
def jitter_points(spark, sf):
    points = B.embedding_points(spark, sf)
    return spatial.jitter_points(points, 500.0, key="det_id")


@query
def vertex_attribute_join(spark, sf):
    vertices = files.read_layer(spark, f"{sf}/lineitem.parquet").select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").alias("vertex"),
        F.col("l_extendedprice").alias("long"),
        F.col("l_quantity").alias("lat"),
    )
    features = files.read_layer(spark, f"{sf}/orders.parquet").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("road_class")
    )
    keep = F.col("road_class").isin("1-URGENT", "2-HIGH")
    return spatial.vertex_attribute_join(vertices, features, keep)


@query
def history_panel(spark, sf):
    out = reports.history_panel(
        B.detections(spark, sf), F.initcap("zone"), lake=(Z2, 42.0), rkm_range=(5.0, 90.0)
    )
    return out.select("tag", "ts", "seq", "rkm", "method", "zone", "location", "page", "panel")


# --- whole plans ---------------------------------------------------------------------------


@query
def cleaning_cascade(spark, sf):
    out = cascade.cleaning_cascade(
        _after_tagging(spark, sf),
        early_rules=_rules(spark).where(F.col("station").isNotNull()),
        late_rules=_rules(spark).where(F.col("station").isNull()),
        zones=(Z1, Z2),
        min_gap=B.MIN_GAP,
        lost_gap=B.LOST_GAP,
        lost_tolerance=B.LOST_TOLERANCE,
        rows_per_slice=None,
    )
    return out.select(
        "tag", "ts", "seq", "zone", "method", "rkm", "distance", "lag_days", "rate", "power"
    )


@query
def clustered_cascade(spark, sf):
    """The cleaning cascade from one table clustered by tag to the next."""
    det = cluster(_after_tagging(spark, sf), files.stage_path(spark, "after-tagging"))
    out = cascade.clean_clustered(
        det,
        files.stage_path(spark, "cleaned"),
        _rules(spark).where(F.col("station").isNotNull()),
        _rules(spark).where(F.col("station").isNull()),
        zones=(Z1, Z2),
        min_gap=B.MIN_GAP,
        lost_gap=B.LOST_GAP,
        lost_tolerance=B.LOST_TOLERANCE,
    )
    return out.rows().select(
        "tag", "ts", "seq", "zone", "method", "rkm", "distance", "lag_days", "rate", "power"
    )


@query
def fixed_pipeline(spark, sf):
    raw = B.keyed_detections(spark, sf).where(F.col("method") == "Fixed").drop("zone", "rkm")
    raw = cleaning.dedup_keep_first(raw, by=("station", "tag", "ts"))
    out = fixed.fixed_pipeline(raw, B.keyed_tags(spark, sf), study_start="2024-01-04")
    return out.select(
        "tag", "ts", "seq", "station", "zone", "rkm", "lat", "long", "method", "sex", "tag_ts"
    )


@query
def mobile_pipeline(spark, sf):
    survey = B.positions(B.detections(spark, sf).where(F.col("method") == "Mobile"))
    # channel 4 is on no list; weak rows have no position
    channel = F.when(F.col("rkm") == 50, 4).otherwise((F.col("tag") % 2 + 1).cast("int"))
    weak = F.col("power") < 5
    srx = survey.select(
        channel.alias("channel"),
        F.col("tag").cast("int").alias("code"),
        "ts",
        "date",
        "seq",
        "power",
        F.when(~weak, F.col("lat")).alias("lat"),
        F.when(~weak, F.col("long")).alias("long"),
    )
    centre = B.detections(spark, sf).groupBy("rkm").agg(F.lit(100.0).alias("power"))
    places = spatial.project_utm(B.positions(centre))
    points = places.select(F.col("rkm").cast("bigint").alias("idx"), "x", "y", "rkm")
    tag_table = B.tags(spark, sf)
    freq = F.when(F.col("tag") % 2 == 0, "149.500").otherwise("149.320")
    keyed = tag_table.withColumn("tag", tag_key(freq.cast("decimal(6,3)"), "tag"))
    out = mobile.mobile_pipeline(mobile.mobile_raw(srx), keyed, points, order=("seq",))
    return out.select(
        "tag", "ts", "seq", "idx", "rkm", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"),
        F.round("dist", 3).alias("dist"),
    )


# --- files ---------------------------------------------------------------------------------


@query
def scan_receiver(spark, sf):
    folder = B.render_receiver(B.keyed_detections(spark, sf))
    rows = receivers.scan_receiver(spark, folder)
    return rows.select("tag", "ts", "station", "code", "power")


def _station_folders(spark, sf):
    folders = B.render_stations(B.keyed_detections(spark, sf))
    return list(folders.values()), {folders[s]: site for s, site in B.STATION_OF.items()}


def _folder(path="src_path"):
    return F.regexp_extract(path, "station=([^/]+)/", 1).alias("folder")


@query
def fixed_raw(spark, sf):
    """Folder by folder: first row per tag and second in file order, one folder's site overridden."""
    folders, station_of = _station_folders(spark, sf)
    rows = fixed.fixed_raw(spark, folders, station_of)
    name = F.regexp_extract("src_file", "^(part)-", 1)
    return rows.select(_folder(), name.alias("file"), "station", "tag", "ts", "power")


@query
def fixed_study(spark, sf):
    """Downloads to detections, as the study reads them."""
    folders, station_of = _station_folders(spark, sf)
    raw = fixed.fixed_raw(spark, folders, station_of)
    out = fixed.fixed_pipeline(raw, B.keyed_tags(spark, sf), study_start="2024-01-04")
    return out.select("tag", "ts", "power", "station", "zone", "rkm", "method", "sex", "tag_ts")


@query
def fixed_quarantine(spark, sf):
    folders, _ = _station_folders(spark, sf)
    return fixed.fixed_quarantine(spark, folders).select(_folder(), "reason", "value")


@query
def fixed_lines(spark, sf):
    """How many lines of each folder are of which kind, header lines apart: files are written by
    task, so their number varies."""
    folders, station_of = _station_folders(spark, sf)
    lines = fixed.fixed_lines(spark, folders, station_of).where(F.col("kind") != "header")
    return lines.groupBy(_folder(), "kind").agg(F.count(F.lit(1)).alias("n"))


@query
def scan_srx(spark, sf):
    folder = B.render_srx(B.positions(B.keyed_detections(spark, sf)))
    rows = receivers.scan_srx(spark, folder)
    return rows.select(
        _day(), "ts", F.col("hour").cast("bigint").alias("hour"), "channel", "code", "power",
        F.round("lat", 6).alias("lat"), F.round("long", 6).alias("long"), "station",
    )


@query
def csv_null_tokens(spark, sf):
    folder = B.render_metadata(B.tags(spark, sf))
    return files.read_csv(
        spark,
        folder,
        "tag BIGINT, sex STRING, fork_length DOUBLE, tag_ts TIMESTAMP_NTZ",
        K.NA_TOKENS_2024,
    )


@query
def csv_rejects(spark, sf):
    """Lengths with decimals do not cast to whole numbers."""
    folder = B.render_metadata(B.tags(spark, sf))
    ddl = "tag BIGINT, sex STRING, fork_length INT, tag_ts TIMESTAMP_NTZ"
    bad = files.csv_rejects(spark, folder, ddl, K.NA_TOKENS_2024)
    return bad.select("column", "text")


@query
def stage_roundtrip(spark, sf):
    det = B.detections(spark, sf)
    stage = files.write_stage(det, files.stage_path(spark, "detections"))
    return stage.select("tag", "ts", "seq", "power", _day(), "rkm", "zone", "station", "method")


