"""The whole study in one call: files in, stage tables and report tables out.

Stage tables are Parquet, each later step starting from the table as written; reports are CSV.
"""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivertrack import constants as K
from rivertrack.operators import cleaning, lookups, reports
from rivertrack.operators.rules import study_rules
from rivertrack.operators.spatial import bbox_membership, write_by_place
from rivertrack.operators.timeline import cluster, slice_hot_tags
from rivertrack.plans import cascade, fixed, maps, mobile, movement
from rivertrack.schema import (
    RKM_POINTS,
    TAG_METADATA_2023,
    TAG_METADATA_2024,
    TAG_TYPES_2023,
    TAG_TYPES_2024,
    fixed_table,
)
from rivertrack.sources import files, receivers
from rivertrack.sources.accounts import LineAccount

# layout -> (schema as read, types meant, NA spellings, adapter)
METADATA = {
    "2024": (TAG_METADATA_2024, TAG_TYPES_2024, K.NA_TOKENS_2024, lookups.tags_2024),
    "2023": (TAG_METADATA_2023, TAG_TYPES_2023, K.NA_TOKENS_2023, lookups.tags_2023),
}


@dataclass
class Inputs:
    """Where the study's files are. ``stations`` lists one directory per fixed station;
    ``station_of`` names the station of directories whose files are labelled otherwise."""

    metadata: str
    stations: list[str]
    surveys: str
    rkm_points: str
    station_of: dict[str, str] = field(default_factory=dict)
    metadata_layout: str = "2024"
    survey_station: str = "Mobile"
    survey_dates: list[str] | None = None


def run_study(spark: SparkSession, inputs: Inputs, out: str) -> dict[str, DataFrame]:
    """Write every table under ``out`` and return the stage tables by name."""
    stages: dict[str, DataFrame] = {}

    def stage(name: str, df: DataFrame, by=()) -> DataFrame:
        stages[name] = files.write_stage(df, f"{out}/{name}", by)
        return stages[name]

    def report(name: str, df: DataFrame) -> None:
        files.write_csv(df, f"{out}/report/{name}")

    # tag metadata
    ddl, typed, tokens, adapter = METADATA[inputs.metadata_layout]
    tags = stage("tags", adapter(files.read_metadata(spark, inputs.metadata, ddl, tokens)))
    bad = stage("tags_rejected", files.csv_rejects(spark, inputs.metadata, typed, tokens))
    report("tags_rejected", reports.count_by(bad, "column"))
    report("length_summary", reports.length_summary(tags))
    report("length_histogram", reports.length_histogram(tags))

    # fixed stations
    lines = LineAccount()
    raw = fixed.fixed_raw(spark, inputs.stations, inputs.station_of, lines)
    heard = stage("fixed_raw", fixed.fixed_detections(raw), ["date"])
    unread = stage("fixed_quarantine", fixed.fixed_quarantine(spark, inputs.stations, lines))
    accounts = [("fixed", lines.check(unread.count()))]
    known, unknown = lookups.split_unknown_stations(heard)
    stage("unknown_stations", unknown)
    fixed_rows = stage("fixed", lookups.after_tagging(known, tags), ["date"])
    report("detections_per_station", reports.count_by(heard, "station"))
    report("false_positive_rate", reports.false_positive_rate(heard, tags))
    report("lost_tags", cleaning.lost_tags(slice_hot_tags(fixed_rows)))

    # mobile surveys
    lines = LineAccount()
    records, rejected = receivers.read_srx(spark, inputs.surveys, account=lines)
    rejected = stage("mobile_quarantine", rejected)
    survey = stage("mobile_raw", mobile.mobile_raw(records))
    accounts.append(("mobile", lines.check(rejected.where("line IS NOT NULL").count())))
    counted = [(name, kind, n) for name, kinds in accounts for kind, n in kinds.items()]
    report("lines", fixed_table(spark, counted, "source STRING, kind STRING, lines BIGINT"))
    report("freqs_per_survey", reports.count_by(survey, "date", "frequency"))
    initial = stage("mobile_initial", mobile.mobile_initial(survey, tags))
    points = spark.read.schema(RKM_POINTS).parquet(inputs.rkm_points)
    placed = mobile.mobile_rkm(initial, points)
    mobile_rows = stage("mobile", placed.withColumn("station", F.lit(inputs.survey_station)))

    # cleaning: from one table clustered by tag to the next
    union = cascade.unified_timeline(
        cascade.with_station_positions(fixed_rows), mobile_rows, tags
    )
    det = cluster(union, f"{out}/detections")
    cleaned = cascade.clean_clustered(
        det,
        f"{out}/detections_clean",
        study_rules(spark, "early"),
        study_rules(spark, "lost_tag", "odd"),
    )
    stages["detections"], stages["detections_clean"] = det.rows(), cleaned.rows()
    clean = cleaned.rows()
    bare = clean.drop("distance", "lag_days", "rate")
    report("impossible_moves", cleaning.impossible_moves(slice_hot_tags(bare)))
    report("lake_outlet_tags", reports.count_by(clean.where(F.col("rkm") == K.LAKE_RKM), "tag"))

    # histories, maps, movement
    stage("detection_history", maps.detection_history(clean))
    for name, points in (
        ("survey", maps.survey_points(clean, inputs.survey_dates)),
        ("last_detection", maps.last_detection_points(clean)),
    ):
        stages[f"{name}_points"] = write_by_place(points, f"{out}/{name}_points")
        stage(f"{name}_maps", bbox_membership(stages[f"{name}_points"]))
    facts = stage("tag_facts", movement.tag_facts(cleaned))
    for name, df in movement.report_of(facts, tags).items():
        report(name, df)
    return stages
