import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from lattica.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].convert_dtypes().astype(object)
    return sorted(tuple("" if pd.isna(v) else str(v) for v in r) for r in frame.values.tolist())


def test_entry(spark):
    assert entry.entry(spark).columns == ["graph_id", "alias", "in_degree", "out_degree", "reason", "forced", "policy"] and entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, sf_dir, name):
    a, b = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and rows(a) == rows(b)


SPLITS = sorted(n for n in set(QUERIES) - set(ORACLES) if n.endswith(("_partition", "_clusters")))


@pytest.mark.parametrize("name", SPLITS)
def test_splits_cover_all_that_are_no_hubs(spark, duck, sf_dir, name):
    """Every node once, and clusters numbered by name and first member."""
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = duck.sql(ORACLES["leiden_cover"]).df()
    hubs = set() if name == "map_partition" else set(got.alias) - set(want.alias)
    assert not hubs and set(want.alias) <= set(got.alias) and got.alias.is_unique
    heads = got.groupby("cluster_id").agg(name=("cluster_name", "first"), first=("alias", "min"), names=("cluster_name", "nunique")).sort_index()
    assert (heads.names == 1).all() and heads.index.tolist() == list(range(1, len(heads) + 1)) and list(zip(heads.name, heads["first"], strict=True)) == sorted(zip(heads.name, heads["first"], strict=True))


def test_refinement_by_rounds_is_that_of_one_task(spark, sf_dir):
    one, rounds = (QUERIES[n](spark, sf_dir).toPandas() for n in ("leiden_partition", "refined_partition"))
    assert rows(one) == rows(rounds)


def test_files_and_index(spark, sf_dir):
    files = {r["file_name"]: r["content"] for r in QUERIES["output_files"](spark, sf_dir).collect()}
    members = QUERIES["prefix_partition"](spark, sf_dir).toPandas()
    page = QUERIES["index_page"](spark, sf_dir).first()["content"]
    clusters = members.groupby("cluster_id").cluster_name.first()
    assert len([f for f in files if f not in ("overview.puml", "shared_types.puml")]) == len(clusters)
    for name, own in members.groupby("cluster_id"):
        assert sum(f" as {a} " in c or f" as {a}\n" in c for a in own.alias[:1] for c in files.values()) >= 1
    assert all(c.startswith("@startuml") and c.rstrip().endswith("@enduml") for c in files.values()) and all(n in page for n in clusters)


def test_auto_decides_once_a_group(spark, sf_dir):
    got = QUERIES["auto_decisions"](spark, sf_dir).toPandas()
    first = got[got.stage == "initial"]
    assert len(first) == 1 and set(got.chosen) <= {"prefix", "leiden"}
    better = [(not r.leiden_satisfies, r.leiden_cut) < (not r.prefix_satisfies, r.prefix_cut) for r in got.itertuples()]
    assert [r == "leiden" for r in got.chosen] == better


def test_every_query_is_checked():
    assert set(QUERIES) - set(ORACLES) - set(SPLITS) == {"output_files", "index_page", "auto_decisions"}
