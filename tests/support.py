"""Data folders, and comparison with SQL."""

from __future__ import annotations

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df, *order):
    """Rows as tuples, sorted."""
    return sorted((tuple(r) for r in df.collect()), key=repr)


def same_as_sql(df, con, sql):
    columns = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = sorted(con.sql(f"SELECT {quoted} FROM ({sql})").fetchall(), key=repr)
    got = rows(df.select(*columns))
    assert got == want
    assert sorted(con.sql(sql).columns) == columns
