import importlib

import corpus_pipeline
import pytest
from corpus import EDGES, base_features, edge_documents

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.01"
LATER = [name for name, _ in corpus_pipeline.STAGES]


@pytest.fixture(scope="module")
def steps(spark):
    """What each stage makes of the one before."""
    from siftlog.session import stage

    made = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for name, step in corpus_pipeline.STAGES:
        made.append(stage(step(spark, made[-1], FOLDER), name))
    return made


def test_stages(steps):
    documents = steps[0].columns
    assert LATER == ["quality_rules", "dedup_lines", "drop_near_duplicates", "decontaminate", "mix_sources"]
    assert all(step.columns == documents for step in steps[:-1])
    counts = [step.count() for step in steps]
    assert counts == sorted(counts, reverse=True)
    assert counts[1] == counts[2] and counts[4] == counts[5] and counts[0] > counts[1] and counts[3] > counts[4]
    assert counts[-1] > 0.6 * counts[0]


def test_rules_hold_after_each_stage(steps):
    assert not any(base_features(row.text)[-1] for row in steps[1].collect())
    items = [row.text for row in steps[0].sparkSession.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert any(item in row.text for row in steps[1].collect() for item in items)
    assert not any(item in row.text for row in steps[4].collect() for item in items)
    assert all(row.n_chars == len(row.text) for row in steps[2].collect())


def test_run_is_the_stages(spark, steps):
    found = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, steps[-1].collect()))


@pytest.mark.parametrize("name", LATER)
def test_odd_rows(spark, name):
    """Nulls, empty and repeated rows, clashing names and empty tables in every stage."""
    step = dict(corpus_pipeline.STAGES)[name]
    for rows in (EDGES, []):
        docs = edge_documents(spark, rows)
        made = step(spark, docs, "/root/testdata/sf0.001")
        assert made.columns == docs.columns or name == LATER[-1]
        assert made.count() <= len(rows)


def test_registered():
    importlib.reload(entry)
    names = set(entry.queries())
    assert "pipeline" in names
    assert all(any(name.startswith(f"op{n}_") for name in names) for n in range(1, 11))
    assert set(entry.oracle_sql()) <= names
