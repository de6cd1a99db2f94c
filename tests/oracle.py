"""Compares a registered query with its SQL as DuckDB runs it on the same tables."""

import glob
import os

import duckdb


def assert_equal_rows(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    frame = query(spark, sf_dir)
    con.execute(sql)
    names = [d[0] for d in con.description]
    want = con.fetchall()
    assert sorted(names) == sorted(frame.columns)
    got = [tuple(r[n] for n in sorted(names)) for r in frame.collect()]
    want = [tuple(r[names.index(n)] for n in sorted(names)) for r in want]
    plain = lambda rows: sorted((tuple(list(x) if isinstance(x, (list, tuple)) else x for x in r) for r in rows), key=repr)
    got, want = plain(got), plain(want)
    assert len(got) == len(want), (len(got), len(want))
    different = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not different, (len(different), different[:3])
