"""Run a query and its SQL side by side."""

import duckdb
import numpy as np
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _kind(dtype):
    name = str(dtype)
    if name.startswith("datetime"):
        return "time"
    if name == "bool":
        return "bool"
    return {"i": "int", "u": "int", "f": "float"}.get(getattr(dtype, "kind", "O"), "text")


def differences(ours: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    """None if both hold the same rows, in any order, to the last bit."""
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} != {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    columns = sorted(ours.columns)
    frames = []
    for df in (ours, theirs):
        out = {}
        for c in columns:
            v = df[c]
            if _kind(v.dtype) == "time":
                v = v.astype("datetime64[us]").astype("int64").where(v.notna())
            if _kind(v.dtype) in ("int", "float", "bool"):
                out[c] = v.astype("float64")
            else:
                out[c] = v.map(lambda x: "<NULL>" if pd.isna(x) else str(x))
        frame = pd.DataFrame(out)
        frames.append(frame.sort_values(columns).reset_index(drop=True))
    a, b = frames
    for c in columns:
        x, y = a[c], b[c]
        if str(x.dtype) != str(y.dtype):
            return f"{c}: {ours[c].dtype} != {theirs[c].dtype}"
        same = (x == y) | (x.isna() & y.isna())
        if not same.all():
            at = np.flatnonzero(~same.to_numpy())
            i = at[0]
            return f"{c}: {len(at)} rows differ, first {a.loc[i].to_dict()} / {b.loc[i].to_dict()}"
    return None
