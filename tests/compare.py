"""Run a registered query in Spark and its SQL in DuckDB and compare rows as multisets, in DuckDB."""

from __future__ import annotations

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()

# Spark type -> DuckDB type a column must have on the other side.
KINDS = {
    "string": {"VARCHAR"}, "int": {"INTEGER"}, "bigint": {"BIGINT"}, "double": {"DOUBLE"}, "boolean": {"BOOLEAN"},
    "date": {"DATE"}, "timestamp_ntz": {"TIMESTAMP"},
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def differences(df, con, sql: str, show: int = 4) -> list[str]:
    names = sorted(df.columns)
    con.execute(f"CREATE OR REPLACE TEMP TABLE theirs AS {sql}")
    theirs = dict(con.execute("SELECT column_name, data_type FROM information_schema.columns WHERE table_name = 'theirs'").fetchall())
    if sorted(theirs) != names:
        return [f"columns {names} against {sorted(theirs)}"]
    found = [f"type of {name}: {kind} against {theirs[name]}" for name, kind in df.dtypes
             if theirs[name] not in KINDS.get(kind, {theirs[name]})]
    con.register("mine", df.toArrow())
    # Decimals come back as they are on one side and as floats on the other.
    columns = ", ".join(f'CAST("{n}" AS DOUBLE) AS "{n}"' if theirs[n].startswith("DECIMAL") else f'"{n}"' for n in names)
    for label, one, other in (("only here ", "mine", "theirs"), ("only there", "theirs", "mine")):
        rest = con.execute(f"SELECT {columns} FROM {one} EXCEPT ALL SELECT {columns} FROM {other}").fetchall()
        if rest:
            found += [f"{len(rest)} rows {label}"] + [f"{label} {row}" for row in rest[:show]]
    return found
