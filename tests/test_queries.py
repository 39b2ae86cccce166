"""Every query that has SQL gives what DuckDB gives for it."""

import math
import os

import duckdb
import pytest

from matchloom.plans import registry

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, bool):
        return int(v)
    return list(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = entry.queries()[name](spark, sf_dir)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(got.columns)
    a = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in got.collect()), key=repr)
    b = sorted((tuple(plain(v) for _, v in sorted(zip(names, row, strict=True))) for row in cur.fetchall()), key=repr)
    assert a == b


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_inner_partition_reads_its_manifest_once(spark, sf_dir):
    """The texts are normalised for the manifest only, not again for each of its uses."""
    plan = entry.queries()["inner_partition"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "fold_0_role" in plan


def test_inputs_are_made_once_and_texts_stay_where_they_are(spark, sf_dir):
    from matchloom.sources import state as src

    made = src.inputs(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert made.index("Join Inner") < made.index("sha2(cast(text")  # below the join with the applications
    for name in ("reconcile_report", "publication_decisions"):
        assert "text#" not in registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
