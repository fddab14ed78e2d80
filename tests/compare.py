"""Run every named query and its SQL statement and compare schema and rows.

    python tests/compare.py [scale folder] [part of a key ...]
"""

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(table):
    """Arrow table to (schema, sorted rows), columns by name."""
    names = sorted(table.column_names)
    kinds = {n: str(table.schema.field(n).type).replace("[ns]", "[us]").replace("large_", "") for n in names}
    columns = [table.column(n).to_pylist() for n in names]
    rows = sorted(zip(*columns), key=lambda r: [(x is not None, str(x)) for x in r])
    return kinds, rows


def difference(df, con, sql):
    """None if equal, else a short description."""
    kinds, rows = plain(df.toArrow())
    found = con.execute(sql).to_arrow_table()
    other_kinds, other = plain(found)
    if kinds != other_kinds:
        return "schema " + str({k: (kinds.get(k), other_kinds.get(k)) for k in kinds.keys() | other_kinds.keys() if kinds.get(k) != other_kinds.get(k)})
    if len(rows) != len(other):
        return f"rows {len(rows)} against {len(other)}"
    bad = [(a, b) for a, b in zip(rows, other) if a != b]
    if bad:
        return f"{len(bad)} of {len(rows)} rows differ: {list(kinds)} {bad[0][0]} against {bad[0][1]}"
    return None


def main():
    import __spark_entry__ as entry

    from shelfscope.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session(
        "compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "16g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = connect(folder), entry.oracle_sql(), 0
    for key, run in entry.queries().items():
        if wanted and not any(w in key for w in wanted):
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            problem = difference(df, con, sqls[key]) if key in sqls else f"no statement, {df.count()} rows"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        failed += problem is not None
        print(f"RESULT {'ok  ' if problem is None else 'FAIL'} {key} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"RESULT {failed} problems")


if __name__ == "__main__":
    main()
