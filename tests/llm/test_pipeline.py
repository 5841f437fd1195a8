"""The pipeline: every stage's decisions against the operators, and the entry module without the subpackage."""

import os
import shutil
import subprocess
import sys

import corpus_pipeline
import pytest
from slotwise.llm import decontamination, weak_labels
from slotwise.llm.store import keep

import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(keep(stage(spark, out[-1], SF)))
    return out


def texts(df):
    return {(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()}


def test_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[1:-1])


def test_classifier_keeps_what_it_says(stages):
    kept = {r.doc_id for r in weak_labels.classify(stages[0]).where("kept").collect()}
    assert {d for d, _ in texts(stages[1])} == kept and len(kept) > 100


def test_lines(stages):
    before = sorted(texts(stages[1]))
    want = {(d, t) for (d, t), (_, old) in zip(brute.line_chunks(before, 3), before) if t.strip() or t == old}
    assert texts(stages[2]) == want


def test_one_document_of_each_class(stages):
    before = sorted(texts(stages[2]))
    classes = brute.weighted_jaccard_classes(before)
    assert {d for d, _ in texts(stages[3])} == {d for d, c in classes.items() if d == c}


def test_leaks_go(spark, stages):
    leaks = {r.doc_id for r in decontamination.find_leaks(stages[3], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert texts(stages[4]) == {(d, t) for d, t in texts(stages[3]) if d not in leaks}


def test_all_that_is_left_is_packed(spark, stages):
    packed = stages[5].collect()
    assert {r.doc_id for r in packed} == {d for d, _ in texts(stages[4])}
    whole = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, packed))


def test_entry_without_the_subpackage(tmp_path):
    """A copy without llm, its tests and the pipeline: the entry module loads, and no other module misses them."""
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    shutil.copytree(f"{root}/slotwise", tmp_path / "slotwise", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(f"{root}/tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import sys, os; sys.path.insert(0, os.getcwd()); import __spark_entry__ as e; assert not any(n.startswith('op') and n[2].isdigit() for n in e.queries()) and len(e.queries()) > 190"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    done = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stdout
