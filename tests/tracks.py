"""Synthetic detections for tests: one tag holds most rows, in bursts, with shared instants."""

import random
from datetime import datetime, timedelta

SCHEMA = (
    "tag STRING, ts TIMESTAMP_NTZ, seq BIGINT, date DATE, rkm DOUBLE, zone STRING, "
    "station STRING, method STRING, power DOUBLE, tag_ts TIMESTAMP_NTZ"
)
ZONES = [
    ("1", "Bulkley River", -0.7),
    ("2", "Bulkley River", 42.0),
    ("6", "Morice Lake", 201.0),
    ("4", "Nanika River", 214.0),
    ("5", "Atna River", 226.5),
]
START = datetime(2024, 7, 4)


def detections(seed=1, hot=600, cold=12, tags=6):
    rng = random.Random(seed)
    rows = []

    def add(tag, at):
        station, zone, rkm = rng.choice(ZONES[:3] if rng.random() < 0.97 else ZONES)
        method = rng.choice(["Fixed", "Fixed", "Mobile"])
        if method == "Mobile":
            station, rkm = "Mobile", float(rng.randint(0, 230))
        power = None if rng.random() < 0.05 else float(-rng.randint(60, 70))
        rows.append(
            [f"149.500 {tag:03d}", at, 0, at.date(), rkm, zone, station, method, power, START]
        )

    at = START
    for i in range(hot):
        # a lone early row, a long burst, then long silences
        step = rng.choice([0, 0, 3, 5, 13, 40]) if i > 1 else 86400 * 9
        if i % 150 == 149:
            step = 86400 * 2
        at += timedelta(seconds=step)
        add(1, at)
    for _ in range(hot // 5):  # many rows of one instant
        add(1, START + timedelta(days=20))
    for tag in range(2, 2 + tags):
        at = START
        for _ in range(cold):
            at += timedelta(seconds=rng.choice([2, 13, 3600, 90000, 200000]))
            add(tag, at)
    rng.shuffle(rows)
    for i, r in enumerate(rows):
        r[2] = i
    return [tuple(r) for r in rows]


def timelines(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out
