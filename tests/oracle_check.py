"""Compares registered queries with their DuckDB SQL: row counts, column names and sorted values."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "NULL"
        if isinstance(v, pd.Timestamp):
            return v.isoformat()
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, float):
            return repr(float(v))
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in frame.astype(object).itertuples(index=False, name=None))


KIND = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
        "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP"}


def compare(spark_df, con, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    relation = con.sql(sql)
    theirs = relation.df()
    types = {c: str(t) for c, t in zip(relation.columns, relation.types)}
    ours_types = {f.name: KIND.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in spark_df.schema.fields}
    table = spark_df.toArrow()
    ours = table.to_pandas(integer_object_nulls=True)
    theirs = relation.to_arrow_table().to_pandas(integer_object_nulls=True)
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} vs {sorted(theirs.columns)}"
    if types != ours_types:
        return "types " + str({c: (ours_types[c], types[c]) for c in types if types[c] != ours_types[c]})
    if len(ours) != len(theirs):
        return f"rows {len(ours)} vs {len(theirs)}"
    a, b = canonical(ours), canonical(theirs)
    if a != b:
        first = next((x, y) for x, y in zip(a, b) if x != y)
        return f"values, first difference {first}"
    return None


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    builder = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
    )
    for item in os.environ.get("SPARK_CONF", "").split():
        builder = builder.config(*item.split("=", 1))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in argv or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            problem = compare(df, con, oracle[name]) if name in oracle else f"no oracle, {df.count()} rows"
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"{name:32s} {time.time() - start:6.2f}s  {problem or 'ok'}", flush=True)
    print("different:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
