"""Every query against its SQL on the given tables."""

import compare
import pytest

import __spark_entry__ as entry
from rivertrack.operators.timeline import slice_hot_tags
from rivertrack.workload import binding
from rivertrack.workload.oracle import ORACLE
from rivertrack.workload.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"
NO_SQL = set()


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLE) == NO_SQL
    assert not set(ORACLE) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    ours = QUERIES[name](spark, SF_DIR).toPandas()
    theirs = con.execute(ORACLE[name]).fetchdf()
    assert len(ours) > 0
    assert compare.differences(ours, theirs) is None


SMALL_DIR = "/root/testdata/sf0.001"
TIMELINE_QUERIES = """detection_lag min_gap_filter lost_tag_flag lost_tags movement_rates
impossible_moves speed_filter_fixpoint terminal_zone_lock reach_flag_cumsum first_arrival
arrival_summary arrival_timing_stats priority_union spawner_fate detected_counts
zone_presence_counts cleaning_cascade""".split()


@pytest.mark.parametrize("name", TIMELINE_QUERIES)
def test_query_matches_sql_when_every_tag_is_long(spark, monkeypatch, name):
    def all_sliced(session, sf_dir):
        return slice_hot_tags(binding.detections(session, sf_dir), rows_per_slice=20)

    monkeypatch.setattr(binding, "timelines", all_sliced)
    ours = QUERIES[name](spark, SMALL_DIR).toPandas()
    theirs = compare.connect(SMALL_DIR).execute(ORACLE[name]).fetchdf()
    assert compare.differences(ours, theirs) is None


def test_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
