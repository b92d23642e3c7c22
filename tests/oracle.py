"""Runs a query in Spark and its SQL in DuckDB and compares rows, whatever their order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def rows_of(columns, rows, order):
    at = [columns.index(c) for c in order]
    return sorted(tuple(repr(r[i]) if isinstance(r[i], float) else str(r[i]) for i in at) for r in rows)


def compare(spark, db, sf_dir, query, sql):
    frame = query(spark, sf_dir)
    relation = db.sql(sql)
    order = sorted(frame.columns)
    assert order == sorted(relation.columns)
    ours = rows_of(frame.columns, frame.collect(), order)
    theirs = rows_of(relation.columns, relation.fetchall(), order)
    assert ours == theirs
    return len(ours)
