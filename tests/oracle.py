"""Rows of a query against the rows of its SQL, both as sorted tuples of strings."""

import decimal
import glob
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def connect(sf_dir: str = SF):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        where = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{where}')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        value = round(value, 6)
        return int(value) if value == int(value) else value
    if isinstance(value, bool):
        return value
    return str(value) if value is not None and not isinstance(value, (int, str)) else value


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, sql: str, sf_dir: str = SF) -> int:
    con = connect(sf_dir)
    cursor = con.execute(sql)
    want = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0], (got[0], want[0])
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]))
    for a, b in zip(got[1], want[1], strict=True):
        assert a == b
    return len(got[1])
