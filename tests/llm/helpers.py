import duckdb
import pandas as pd


def against_sql(df, sql, **tables):
    """Rows of a Spark query and of DuckDB SQL over the same pandas tables, as sorted texts."""
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows)
    names = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
    got = [tuple(r[n] for n in names) for r in df.collect()]
    return sorted(map(repr, got)), sorted(map(repr, want))


def frame(spark, schema, rows):
    """A Spark table and its twin in pandas with nullable types."""
    df = spark.createDataFrame(rows, schema)
    kinds = {"bigint": "Int64", "int": "Int32", "string": "string", "double": "Float64"}
    twin = pd.DataFrame({f.name: pd.array([r[i] for r in rows], dtype=kinds[f.dataType.simpleString()]) for i, f in enumerate(df.schema)})
    return df, twin
