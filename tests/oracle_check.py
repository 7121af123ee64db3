"""Compare registered queries with their oracle SQL: python tests/oracle_check.py [sf_dir] [names...]"""

import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def session(cores: int = 8) -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if hasattr(v, "item"):
        return plain(v.item())
    return v


def compare(df, rel) -> str:
    names = sorted(df.columns)
    if names != sorted(rel.columns):
        return f"columns {names} against {sorted(rel.columns)}"
    def key(row):
        return tuple((x is None, str(type(x)) if x is None else "", str(x)) for x in row)
    a = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=key)
    b = sorted((tuple(plain(v) for v in r) for r in rel.select(*[f'"{n}"' for n in names]).fetchall()), key=key)
    if a == b:
        return ""
    only_a, only_b = set(a) - set(b), set(b) - set(a)
    return f"rows {len(a)} against {len(b)}; only here {list(only_a)[:3]}; only oracle {list(only_b)[:3]}"


def main(sf_dir: str, names: list[str]) -> int:
    spark, con = session(), database(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        t = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                problem = compare(df, con.sql(oracles[name]))
            else:
                problem = "" if df.count() >= 0 else "?"
                name += " (no oracle)"
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - t:.1f}s {problem}", flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:])))
