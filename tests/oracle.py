"""Runs registered queries and their SQL side by side: python tests/oracle.py SF_DIR [NAME...]."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def compare(spark, con, query, sql, sf_dir):
    """None if all rows agree, else what differs."""
    got = query(spark, sf_dir).toPandas()
    cols = sorted(got.columns)
    want = con.execute(sql).df()
    if sorted(want.columns) != cols:
        return f"columns {cols} and {sorted(want.columns)}"

    def key(df):
        return sorted(tuple(plain(x) for x in r) for r in df[cols].itertuples(index=False))

    def plain(x):
        if x is None or x is not x or str(x) in ("nan", "NaT", "<NA>"):
            return "null"
        if hasattr(x, "tolist"):
            x = x.tolist()
        if isinstance(x, (list, tuple)):
            return str([plain(y) for y in x])
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
            return f"{float(x) + 0.0:.12g}" if float(x) else "0"
        return str(x)

    a, b = key(got), key(want)
    if a != b:
        only = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        return f"{len(a)} and {len(b)} rows; only here {only[0]}, only there {only[1]}"


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


if __name__ == "__main__":
    import tempfile

    from pyspark.sql import SparkSession

    from helixmill.plans import catalogue

    tmp = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = SparkSession.builder.master(f"local[{os.environ.get('ORACLE_CPUS', '3')}]").config("spark.sql.shuffle.partitions", "6").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", tmp).config("spark.sql.warehouse.dir", tmp).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    sf, names = sys.argv[1], sys.argv[2:]
    con = connect(sf)
    for name, q in catalogue.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        t = time.time()
        try:
            said = compare(spark, con, q, catalogue.oracle_sql()[name], sf) if name in catalogue.oracle_sql() else f"{q(spark, sf).count()} rows, no SQL"
        except Exception as e:
            said = f"{type(e).__name__} {str(e)[:600]}"
        print(f"{name}: {said or 'same'} ({time.time() - t:.1f} s)", flush=True)
