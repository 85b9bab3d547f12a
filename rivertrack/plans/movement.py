"""The movement report: arrivals, efficiency, counts by section and the fate of spawners."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivertrack import constants as K
from rivertrack.functions.times import micros
from rivertrack.operators import arrivals, reports
from rivertrack.operators.timeline import SLICE, Clustered
from rivertrack.sources.files import stage_path, write_stage


def _mobile(zone: str) -> Column:
    return (F.col("method") == "Mobile") & (F.col("zone") == zone)


def sections() -> dict[str, Column]:
    """Where a tag counts as present: at a section's station, or in a survey of its waters."""
    station = F.col("station")
    rkm = F.col("rkm")
    return {
        "fallback": station == "1",
        "bulkley": (station == "2")
        | (_mobile("Bulkley River") & rkm.between(42, 109))
        | _mobile("Morice River")
        | (_mobile("Bulkley River") & rkm.between(0, 42)),
        "nanika": (station == "4") | _mobile("Nanika River"),
        "atna": (station == "5") | _mobile("Atna River"),
        "upper_bulkley": _mobile("Upper Bulkley River")
        & ~F.col("tag").isin(
            *[f"{freq}0 {int(code):03d}" for freq, code in map(str.split, K.NOT_UPPER_BULKLEY_TAGS)]
        ),
        "morice_lake": (station == "6") | _mobile("Morice Lake"),
    }


def present(det: DataFrame) -> DataFrame:
    """Detections proper, without the tagging rows."""
    return det.where(F.col("station").isin(*K.DETECTION_STATIONS))


def fate_claims(where: dict[str, Column]) -> list[tuple[str, Column, str]]:
    lake_system = where["morice_lake"] | where["nanika"] | where["atna"]
    return [
        ("upper_bulkley", where["upper_bulkley"], "first"),
        ("morice_system", lake_system, "last"),
        ("atna", where["atna"], "first"),
        ("nanika", where["nanika"], "first"),
    ]


def spawner_fate(det: DataFrame, where: dict[str, Column] | None = None) -> DataFrame:
    """One row per tag that reached spawning water: its first detection in the upper river, its
    last one in the lake system, its first in each terminal river, in that order of claim."""
    return arrivals.first_claim(present(det), fate_claims(where or sections()), micros("ts"))


def tag_facts(
    det: DataFrame | Clustered,
    targets=tuple(K.ARRIVALS),
    stations=tuple(K.EFFICIENCY_STATIONS),
    where: dict[str, Column] | None = None,
    claims: list[tuple[str, Column, str]] | None = None,
    detected=K.DETECTION_STATIONS,
    survey_station: str = "Mobile",
) -> DataFrame:
    """One row per tag with all that the report says of it: first times, flags, survey days, and
    the row its fate is read from. One aggregation, without a shuffle where ``det`` lies
    clustered by tag; the report's tables are counts over these rows."""
    where = sections() if where is None else where
    claims = fate_claims(where) if claims is None else claims
    here = F.col("station").isin(*detected)
    flags = {
        "present": here,
        **reports.efficiency_conditions(stations),
        **reports.detected_conditions(),
        **{f"in_{n}": here & c for n, c in where.items()},
    }
    number, name, place = arrivals.claim(claims, micros("ts"))

    def facts(part: DataFrame) -> DataFrame:
        row = F.struct(*[c for c in part.columns if c not in ("tag", "seq", SLICE)])
        claimed = F.struct(
            number.alias("claim"), place.alias("place"), "seq", name.alias("source"), row.alias("row")
        )
        survey_day = F.when(F.col("station") == survey_station, F.col("date"))
        return reports.tag_flags(
            part,
            flags,
            **arrivals.first_times(targets),
            surveys=F.count_distinct(survey_day),
            sex_number=F.max(F.when(here, reports.sex_number())),
            fate=F.min(F.when(here & number.isNotNull(), claimed)),
        )

    return det.per_tag(facts) if isinstance(det, Clustered) else facts(det)


def report_of(
    facts: DataFrame,
    tags: DataFrame,
    targets=tuple(K.ARRIVALS),
    stations=tuple(K.EFFICIENCY_STATIONS),
    where=None,
    surveys: int = 3,
) -> dict[str, DataFrame]:
    """All tables of the report, lazily, from ``tag_facts``; write those first, as each table
    reads them once."""
    names = list(sections() if where is None else where)
    summary = arrivals.summarise_arrivals(facts, tags.select("tag", "tag_ts", "sex", "fork_length"), targets)
    seen = facts.where("present")
    in_sections = seen.select(F.col("sex_number").alias("sex"), *[F.col(f"in_{n}").alias(n) for n in names])
    return {
        "arrival_summary": summary,
        "arrival_timing_stats": arrivals.arrival_timing_stats(summary, targets),
        "detection_efficiency": reports.count_efficiency(facts, stations),
        "detected_counts": reports.count_detected(seen.select("tag", "any", "fixed", "mobile"), tags),
        "undetected_tags": reports.undetected_tags(tags, seen),
        "multi_survey_tags": facts.where(F.col("surveys") >= surveys).select("tag", "surveys"),
        "zone_presence_counts": reports.count_presence(in_sections, names),
        "spawner_fate": facts.where(F.col("fate").isNotNull()).select(
            "tag", "fate.seq", "fate.row.*", "fate.source"
        ),
    }


def movement_report(det: DataFrame | Clustered, tags: DataFrame) -> dict[str, DataFrame]:
    """``report_of`` the facts of cleaned detections, which are aggregated once and written."""
    spark = tags.sparkSession
    return report_of(write_stage(tag_facts(det), stage_path(spark, "tag-facts")), tags)
