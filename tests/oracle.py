"""Runs registered queries against their SQL checks. Usable as a script."""

from __future__ import annotations

import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(str(r[c]) for c in names) for r in df.collect()))


def check_rows(con, sql: str):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(str(r[i]) for i in order) for r in cursor.fetchall())


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from lintlake.session import build_session

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                               "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    queries, checks = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, function in queries.items():
        if wanted and name not in wanted and not any(w.endswith("*") and name.startswith(w[:-1]) for w in wanted):
            continue
        try:
            start = time.time()
            names, rows = spark_rows(function(spark, sf_dir))
            took = time.time() - start
            if name not in checks:
                print(f"----  {name}: {len(rows)} rows, {took:.1f}s, no check", flush=True)
                continue
            start = time.time()
            expected_names, expected = check_rows(con, checks[name])
            sql_took = time.time() - start
        except Exception as error:  # report and go on
            bad += 1
            print(f"ERROR {name}: {str(error)[:1500]}", flush=True)
            continue
        same = names == expected_names and rows == expected and rows
        bad += not same
        print(f"{'ok   ' if same else 'DIFF '} {name}: {len(rows)} rows vs {len(expected)}, {took:.1f}s / sql {sql_took:.1f}s",
              flush=True)
        if not same:
            print("   names", names, expected_names) if names != expected_names else None
            only = [r for r in rows if r not in set(expected)][:3]
            missing = [r for r in expected if r not in set(rows)][:3]
            print("   spark only:", [tuple(x[:200] for x in r) for r in only])
            print("   sql only:  ", [tuple(x[:200] for x in r) for r in missing], flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
