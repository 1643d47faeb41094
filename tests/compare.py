"""Run named queries in Spark and in DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def _table(names: list[str], rows) -> tuple[list[str], list[str]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(repr([_plain(r[i]) for i in order]) for r in rows)


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP",
         "timestamp_ntz": "TIMESTAMP"}


def type_gaps(df, description) -> list[str]:
    """Columns whose Spark and SQL types differ."""
    wanted = {d[0]: str(d[1]) for d in description}
    return [f"{f.name}: {f.dataType.simpleString()} / {wanted[f.name]}" for f in df.schema
            if TYPES.get(f.dataType.simpleString()) != wanted[f.name]]


def compare(spark, sf_dir: str, run, sql: str | None, con) -> str | None:
    """None when equal, else what differs."""
    df = run(spark, sf_dir)
    names, rows = _table(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if rows else "no rows"
    found = con.execute(sql)
    wanted_names, wanted = _table([d[0] for d in found.description], found.fetchall())
    if names != wanted_names:
        return f"columns {names} != {wanted_names}"
    gaps = type_gaps(df, found.description)
    if gaps:
        return f"types {gaps}"
    if len(rows) != len(wanted):
        return f"{len(rows)} rows != {len(wanted)}"
    differing = [(a, b) for a, b in zip(rows, wanted) if a != b]
    if not rows:
        return "no rows on either side"
    return None if not differing else f"{len(differing)} rows differ, such as\n   {differing[0][0]}\n   {differing[0][1]}"


if __name__ == "__main__":
    from cohortlens.plans import load
    from cohortlens.session import local_session

    queries, oracles = load()
    sf = sys.argv[1]
    chosen = sys.argv[2:] or list(queries)
    session = local_session()
    session.sparkContext.setLogLevel("ERROR")
    base = connect(sf)
    bad = 0
    for name in chosen:
        start = time.time()
        try:
            result = compare(session, sf, queries[name], oracles.get(name), base)
        except Exception as exc:  # noqa: BLE001
            result = f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += result is not None
        mark = ("sql " if name in oracles else "rows") if result is None else "BAD "
        print(f"{mark} {time.time() - start:6.2f}s {name}" + (f"\n   {result}" if result else ""), flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} good")
