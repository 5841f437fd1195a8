"""Results over whole inputs: no part of a text, group or rule set is left out by size or frequency."""

import math
from itertools import combinations

import pytest
from conftest import prose
from slotwise.llm import arrays, decontamination, line_crf, near_dup, textstats, toxicity, urls, weak_labels
from test_methods import language_model  # noqa: F401


def test_leaks_shared_by_many_documents_are_found(spark):
    """Edited and half copies in 25 documents, whose unbroken seeds are all frequent."""
    items = [(i, prose(40, 300 + i)) for i in range(2)]
    docs = []
    for k in range(25):
        edited = [w if j % 6 else "edited" for j, w in enumerate(items[0][1].split())]
        half = items[1][1].split()[:20]
        docs.append((100 + k, " ".join([prose(150, 4000 + k), *edited, prose(80, 5000 + k)])))
        docs.append((200 + k, " ".join([prose(150, 6000 + k), *half, prose(80, 7000 + k)])))
        docs.append((300 + k, prose(250, 8000 + k)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    leaks = decontamination.find_leaks(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in leaks} == {(100 + k, 0) for k in range(25)} | {(200 + k, 1) for k in range(25)}


def test_case_of_a_long_line_is_counted_over_all_of_it():
    """Seven-letter words and single spaces: every eighth character is a capital."""
    upper = 1 << line_crf.FEATURES.index("upper>=60%"), 1 << line_crf.FEATURES.index("upper<20%")
    bits, _ = line_crf.line_bits("\n".join([" ".join(["Boulder"] * 60), " ".join(["bOULDER"] * 60)]))
    assert [[bool(b & u) for u in upper] for b in bits.tolist()] == [[False, True], [True, False]]
    for text in ("", "aBC 1", "Ärger Ünd ß ǅ Ⅷ ⓐ", "日本 A", "x\ud800Y", "İI\u0345"):
        assert textstats.case_counts(text) == (sum(map(str.isupper, text)), sum(map(str.isalpha, text)))


def test_weak_label_statistics_and_shapes_are_those_of_whole_texts():
    text = "aB" * 4000
    assert weak_labels.statistics(text, arrays.WordHashes())[0]["upper"] == 0.5
    shapes = weak_labels.Shapes()
    assert shapes[b"a-" * 12 + b"1"] != shapes[b"a-" * 12 + b"?"]


@pytest.mark.parametrize("seen,word", [("iddiot", "idiot"), ("stuupid", "stupid"), ("mm0ron", "moron"), ("i  d\ti\no\u00a0t", "idiot"), ("lo se r", "loser"), ("worthless", "worthless")])
def test_doubled_letters_and_any_spacing_are_restored(language_model, seen, word):  # noqa: F811
    assert word in toxicity.restored_words(f"the {seen} thing", toxicity.Restored(language_model))


def test_rules_of_every_length_are_mined(spark):
    """Four tokens that block together only: every three of them are common on allowed pages. Against brute force."""
    four = ["p:a", "p:b", "p:c", "p:d"]
    pages = [(four, True)] * 3 + [(list(t) + ["p:e"], False) for t in combinations(four, 3)] * 4
    want = {}
    for n in range(1, 6):
        for s in combinations([*four, "p:e"], n):
            votes = [b for t, b in pages if set(s) <= set(t)]
            if sum(votes) and sum(votes) / len(votes) >= 0.6:
                want[s] = sum(votes) / len(votes)
    got = urls.mine_rules(spark.createDataFrame(pages, "tokens array<string>, blocked boolean"))
    assert {tuple(sorted(r.tokens)): r.confidence for r in got.collect()} == want == {tuple(four): 1.0}


def test_agreement_loses_next_to_no_similar_pair():
    s, n = near_dup.SIMILARITY, near_dup.SAMPLES
    assert sum(math.comb(n, k) * s ** k * (1 - s) ** (n - k) for k in range(near_dup.AGREE)) < 1e-6
