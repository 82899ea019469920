"""Every registered query of the library against its SQL, on the smallest tables."""

import os
import shutil
import subprocess
import sys

import pytest

from gapline.plans import ORACLE_SQL, QUERIES
from tests.conftest import ROOT
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(tiny):
    return connect(tiny)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_parity(name, spark, tiny, con):
    compare(con, QUERIES[name](spark, tiny), ORACLE_SQL[name])


def test_catalogue():
    assert len(QUERIES) == 131
    assert set(QUERIES) - set(ORACLE_SQL) == {"entity_resolution", "nmf_topics", "train_complaint_lr", "multilabel_lr", "group_kfold_split", "locked_split", "nested_group_split", "locked_aspect_split", "sentiment_queue", "clause_queue"}


def test_entry_without_the_training_data_operators(tmp_path):
    """The entry point and all other queries import where that subpackage and its pipeline are gone."""
    for name in ("__spark_entry__.py", "gapline"):
        src = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "gapline" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) == 131 and set(e.oracle_sql()) <= set(q); print('fine')"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.stdout.strip() == "fine", out.stderr


def test_entry_registry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_entity_resolution(spark, tiny):
    rows = QUERIES["entity_resolution"](spark, tiny).collect()
    assert len({(r.source, r.name) for r in rows}) == len(rows)
    assert {r.status for r in rows} <= {"auto", "new", "new_needs_manual_review"}


def test_grouped_split_is_disjoint(spark, tiny):
    rows = QUERIES["group_kfold_split"](spark, tiny).collect()
    assert len({r.l_suppkey for r in rows}) == len(rows)
    assert {r.fold for r in rows} <= set(range(5))


def test_locked_split(spark, tiny):
    rows = QUERIES["locked_split"](spark, tiny).collect()
    assert {r.split for r in rows} == {"train", "test"}
    assert len({r.l_suppkey for r in rows}) == len(rows)


def test_complaint_classifier(spark, tiny):
    rows = QUERIES["train_complaint_lr"](spark, tiny).collect()
    assert len(rows) == 181
    assert all(0 <= r.precision <= 1 and 0 <= r.recall <= 1 for r in rows)
    assert [r.recall for r in sorted(rows, key=lambda r: r.threshold)] == sorted((r.recall for r in rows), reverse=True)


def test_multilabel_and_topics(spark, tiny):
    rows = QUERIES["multilabel_lr"](spark, tiny).collect()
    assert all(0 <= r.p <= 1 for r in rows)
    top = QUERIES["nmf_topics"](spark, tiny).collect()
    assert all(0 <= r.strength <= 1 and 0 <= r.topic < 12 for r in top)
