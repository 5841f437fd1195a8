"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

from collections import Counter

import brute
import pytest
from slotwise.llm import decontamination, line_crf, line_dedup, near_dup, packing, repeats, substring_dedup, suffix_dedup, toxicity, urls, weak_labels


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


@pytest.fixture(scope="module")
def rows(edge_docs):
    return [(r.doc_id, r.text) for r in edge_docs.collect()]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, None, 1, "a"), (2, 1, 0, "b"), (2, 1, 0, "b"), (None, 0, 1, "c"), (5, 0, None, "d")], "doc_id long, quality int, toxic int, text string")


def test_line_crf(edge_docs, no_docs, rows):
    out = line_crf.label_lines(edge_docs)
    assert ids(out) == Counter(d for d, _ in rows)
    by = {r.doc_id: r for r in out.collect()}
    assert (by[3].n_words, by[4].n_words, by[5].n_words) == (0, 0, 0) and by[3].base_failed and not by[4].kept
    assert by[1].kept and by[10].base_failed
    assert line_crf.label_lines(no_docs).count() == 0


def test_weak_labels(edge_docs, no_docs, rows):
    out = weak_labels.classify(edge_docs)
    assert ids(out) == Counter(d for d, _ in rows)
    assert all(0 <= r.score <= 1 for r in out.collect())
    assert weak_labels.classify(no_docs).count() == 0


def test_toxicity(edge_docs, no_docs, labels, rows):
    out = toxicity.score_toxicity(edge_docs, labels)
    assert ids(out) == Counter(d for d, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out.collect())
    assert toxicity.score_toxicity(no_docs, labels.where("false")).count() == 0


def test_packing(edge_docs, no_docs, rows):
    got = packing.pack_documents(edge_docs).collect()
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(d for d, _ in rows)
    assert packing.pack_documents(no_docs).count() == 0


@pytest.mark.parametrize("hot", [2000, 1])
def test_word_windows(edge_docs, no_docs, rows, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_CELLS", hot)
    out = substring_dedup.remove_repeated_words(edge_docs).selectExpr("doc_id", "n_words", "n_removed", "sha2(kept, 256) AS s")
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(brute.word_windows(rows), key=key)
    assert substring_dedup.remove_repeated_words(no_docs).count() == 0


@pytest.mark.parametrize("hot", [2000, 1])
def test_byte_strings(edge_docs, no_docs, rows, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_CELLS", hot)
    out = suffix_dedup.remove_repeated_bytes(edge_docs).selectExpr("doc_id", "n_bytes", "n_removed", "size(spans) div 2", "sha2(kept, 256) AS s")
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(brute.byte_strings(rows), key=key)
    assert suffix_dedup.remove_repeated_bytes(no_docs).count() == 0


def test_line_dedup(edge_docs, no_docs, rows):
    out = line_dedup.dedup_lines(edge_docs)
    assert out.columns[:len(edge_docs.columns)] == edge_docs.columns
    assert ids(out) == Counter(d for d, _ in rows)
    assert {r.text for r in out.where("doc_id = 4").collect()} == {None}
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_near_dup(edge_docs, no_docs, rows):
    classes, _ = near_dup.near_duplicates(edge_docs)
    assert ids(classes) == Counter(d for d, _ in rows if d is not None)
    by = {r.doc_id: r.class_id for r in classes.collect()}
    assert by[1] == by[2] == 1 and by[8] == by[9] == 8 and by[3] == by[4] == 3 and by[6] == 6
    assert near_dup.near_duplicates(no_docs)[0].count() == 0


def test_decontamination(spark, edge_docs, no_docs):
    text = edge_docs.where("doc_id = 11").first().text
    item = " ".join(text.split()[40:75]).upper()
    bench = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "", "x"), (None, item, "x"), (4, "too short", "x")], "item_id long, text string, doc_id string")
    got = decontamination.find_leaks(edge_docs, bench).collect()
    assert [(r.doc_id, r.item_id, r.score) for r in got] == [(11, 1, 1.0)] and (got[0].start, got[0].end) == (40, 75)
    assert decontamination.find_leaks(no_docs, bench).count() == 0
    assert decontamination.find_leaks(edge_docs, bench.where("false")).count() == 0


def test_urls(spark, labels):
    pages = spark.createDataFrame([(1, None, "a"), (2, "no scheme", "a"), (2, "HTTP://WWW.Example.ORG/en/12?q", "a"), (None, "x://a.com/fr/", "a"), (4, "://", "a"), (5, "s://com", "a"), (5, "s://com", "a"), (6, "a://b.de.com/de/x#y", "q")],
                                  "page_id long, url string, verdict string")
    out = urls.filter_urls(pages, labels)
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out.collect())
    assert got[(1, "", "", None, "allow")] == 1 and got[(2, "", "", None, "allow")] == 1
    assert got[(2, "www.example.org", "/en/12", "example.org/en/1", "block")] == 1
    assert got[(None, "a.com", "/fr/", "com/fr/", "allow")] == 1 and got[(6, "b.de.com", "/de/x", "com/de/", "block")] == 1
    # both rows of page 5 carry the token com and a label that blocks
    assert sum(got.values()) == 8 and got[(5, "com", "", None, "block")] == 2
    assert urls.filter_urls(pages.where("false"), labels).count() == 0
    assert {r.verdict for r in urls.filter_urls(pages, labels.where("false")).where("rule IS NULL").collect()} == {"allow"}
