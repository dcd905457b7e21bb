"""Compares registered queries with their DuckDB SQL: python tests/oracle_check.py SF_DIR [NAME...]"""

import math
import sys
from pathlib import Path

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.4f}"
    return str(int(v)) if isinstance(v, (bool, int)) else str(v)


def compare(df, con, sql):
    """None if the rows are equal, else what differs."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    want = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in rel.fetchall())
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    if want != got:
        odd = [x for x in zip(got, want) if x[0] != x[1]][:3]
        return f"{len(got)} and {len(want)} rows; {order}; {odd}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).parent.parent))
    import __spark_entry__ as e
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sys.argv[1])
    for name, sql in e.oracle_sql().items():
        if not sys.argv[2:] or name in sys.argv[2:]:
            try:
                found = compare(e.queries()[name](spark, sys.argv[1]), con, sql)
            except Exception as x:  # noqa: BLE001
                found = f"error {str(x)[:600]}"
            print(name, found or "equal", flush=True)
