"""Every registered query with SQL gives DuckDB's rows on the smallest tables; the others have a twin here."""

import math
import os

import numpy as np
import pytest

duckdb = pytest.importorskip("duckdb")
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

import __spark_entry__ as entry  # noqa: E402

NAMES = [n for n in entry.plans.QUERIES]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        path = f"{DATA}/{f}"
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        if df[c].dtype.kind in "iufb" or str(df[c].dtype) in ("Int64", "Int32", "boolean"):
            df[c] = df[c].astype("float64")
        else:
            df[c] = df[c].map(lambda v: "" if v is None or v != v else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def twin_p05_embed(got, con):
    """Principal components by singular values."""
    e = con.sql("SELECT vec_id, label, embedding FROM embeddings ORDER BY vec_id").df()
    x = np.array(e["embedding"].tolist(), float)
    fit = x[e["label"] < 5]
    mean = fit.mean(0)
    _, _, v = np.linalg.svd(fit - mean, full_matrices=False)
    want = np.abs((x - mean) @ v[:2].T)
    got = got.sort_values("vec_id")
    assert np.allclose(got[["c0", "c1"]], want, atol=2e-4)


def twin_f01_ks_exact(got, con):
    """Distances by sorting; p-values by counting the paths inside the band one cell after the other."""
    e = con.sql("SELECT event_type AS mode, CAST(user_id AS VARCHAR) AS cell_id, value FROM events").df()
    groups = {k: v["value"].to_numpy() for k, v in e.groupby(["mode", "cell_id"])}
    assert len(got) > 0
    for _, r in got.iterrows():
        a, b = groups[r["mode"], r["cell_id"]], groups["view", r["cell_id"]]
        every = np.sort(np.concatenate([a, b]))
        d = np.abs(np.searchsorted(np.sort(a), every, "right") / len(a) - np.searchsorted(np.sort(b), every, "right") / len(b)).max()
        assert r["ks"] == pytest.approx(d, abs=1e-6)
        n, m = len(a), len(b)
        inside = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n + 1):
            for j in range(m + 1):
                if abs(i * m - j * n) < round(d * n * m):
                    inside[i][j] = 1 if i == j == 0 else (inside[i - 1][j] if i else 0) + (inside[i][j - 1] if j else 0)
        assert r["p_value"] == pytest.approx(1 - inside[n][m] / math.comb(n + m, n), abs=1e-6)
        assert r["similar"] == (r["p_value"] >= 0.05)


TWINS = {"p05_embed": twin_p05_embed, "f01_ks_exact": twin_f01_ks_exact}


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    got = entry.plans.QUERIES[name](spark, DATA).toPandas()
    if name in TWINS:
        TWINS[name](got, con)
    if name not in entry.plans.ORACLE_SQL:
        assert name in TWINS
        return
    a, b = plain(got), plain(con.sql(entry.plans.ORACLE_SQL[name]).df())
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    for c in a:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        assert same.all(), (name, c, a[c][~same].head(3).tolist(), b[c][~same].head(3).tolist())
