"""Spark rows against DuckDB rows of the same tables."""

import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        at = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{at}')")
    return c


def same(a, b) -> bool:
    """Equal; numbers may differ by what the order of additions does."""
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6) or (math.isnan(a) and math.isnan(b))
    return a == b and type(a) is type(b)


def compare(spark, con, run, sql: str, sf_dir: str) -> None:
    df = run(spark, sf_dir)
    floats = {f.name for f in df.schema.fields if f.dataType.typeName() == "double"}
    cols = sorted(df.columns, key=lambda c: (c in floats, c))
    key = lambda row: tuple((x is None, round(x, 3) if isinstance(x, float) and math.isfinite(x) else repr(x)) for x in row)
    got = sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=key)
    assert sorted(con.sql(sql).columns) == sorted(cols)
    want = sorted(con.sql("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({sql})").fetchall(), key=key)
    assert len(got) == len(want)
    assert [p for p in zip(got, want, strict=True) if not all(map(same, *p))][:3] == []
