"""Nothing is lost: long runs, ids with several texts, short and heavily edited benchmark items, disguises of any kind."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from conftest import WORDS, prose
from slotwise.llm import decontamination, near_dup, packing, toxicity
from slotwise.llm.store import keep
from test_methods import language_model  # noqa: F401

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, "#" * 2_000_000, "x" + " \t\n" * 300_000, "word " * 400_000])
def test_long_runs_are_packed(text):
    """2 MB of one character, and ids equal to those of tokenizers."""
    ids = packing.Ids(packing.tokenizer_path())
    got = np.frombuffer(ids(text), "<u4")
    assert len(got) and (text[0] != "w" or got.tolist() == ids.whole.encode(text, add_special_tokens=False).ids)


def test_long_runs_on_spark(spark):
    docs = spark.createDataFrame([(1, " " * 1_000_000), (2, "\n" * 1_000_000)], "doc_id long, text string")
    assert {r.doc_id: r.n for r in packing.pack_documents(docs).groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()} == {1: 1_000_001, 2: 500_001}


@pytest.fixture(scope="module")
def shared_ids(spark):
    """Ten ids with two texts each; the first text of each is copied under another id."""
    rows = []
    for i in range(10):
        rows += [(i, prose(100, 50 + i)), (i, prose(100, 150 + i)), (100 + i, prose(100, 50 + i) + " end")]
    return rows, spark.createDataFrame([(d, t, "en", "web", len(t)) for d, t in rows], DOCS)


def test_texts_of_one_id_are_compared_each_for_itself(shared_ids):
    rows, docs = shared_ids
    classes, links = near_dup.near_duplicates(docs)
    got = Counter((r.doc_id, r.class_id, r.n_links, r.kept) for r in classes.collect())
    want = Counter()
    for i in range(10):
        want.update([(i, i, 1, True), (i, i, 0, True), (100 + i, i, 1, False)])
    assert got == want and links.count() == 10


def test_stage_keeps_every_unique_text(spark, shared_ids):
    rows, docs = shared_ids
    more = spark.createDataFrame([(7, prose(90, 900), "en", None, None), (9, prose(90, 901), "en", None, None), (200, prose(90, 900), "de", None, None), (None, prose(90, 900), "en", None, None),
                                  (9, prose(90, 901), "fr", None, None)], DOCS)
    out = corpus_pipeline.near_duplicates(spark, docs.unionByName(more), "")
    want = Counter((d, t) for d, t in rows if d < 100) + Counter([(7, prose(90, 900)), (9, prose(90, 901)), (None, prose(90, 900))])
    assert Counter((r.doc_id, r.text) for r in out.collect()) == want and out.columns == docs.columns


def test_leaks_of_one_text_leave_the_others_of_its_id(spark, tmp_path):
    item = prose(30, 77)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(5, prose(100, 1) + " " + item), (5, prose(100, 2)), (None, prose(50, 3) + " " + item), (None, prose(100, 4)), (6, None)]
    docs = spark.createDataFrame([(d, t, "en", "web", None) for d, t in rows], DOCS)
    out = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([rows[1], rows[3], rows[4]])


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_any_rows(spark, edge_docs, no_docs, name, stage):
    """Nulls, empty and long texts, repeated rows, extra columns with clashing names, and no rows at all."""
    sf = "/root/testdata/sf0.001"
    out = stage(spark, edge_docs, sf)
    assert set(out.columns) == set(corpus_pipeline.COLUMNS if name != "packing" else ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"))
    assert out.count() > 0
    assert stage(spark, no_docs, sf).count() == 0


def leaks(spark, items, docs):
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r.score for r in decontamination.find_leaks(d, b).collect()}


def test_short_items_match_whole(spark):
    items = [(n, " ".join(f"{w}{n}" for w in WORDS[:n])) for n in range(1, 9)]
    docs = [(n, f"{prose(40, n)} {t.upper()}. {prose(40, 90 + n)}") for n, t in items] + [(20 + n, f"{prose(40, n)} {t.rsplit(' ', 1)[0]} {prose(40, 90 + n)}") for n, t in items[2:7]]
    assert leaks(spark, items, docs) == {(n, n): 1.0 for n in range(3, 9)}


@pytest.mark.parametrize("every", [3, 4, 5])
def test_every_third_word_changed(spark, every):
    items = [(i, prose(40, 300 + i)) for i in range(30)]
    docs = [(i, prose(80, i) + " " + " ".join("edited" if j % every == every - 1 else w for j, w in enumerate(t.split())) + " " + prose(80, 700 + i)) for i, t in items]
    assert leaks(spark, items, docs).keys() == {(i, i) for i in range(30)}


@pytest.mark.parametrize("rate", [0.1, 0.2, 0.3])
def test_recall_over_edits(spark, rate):
    """Words replaced, dropped or added at random: found are at least nine in ten of those that alignment by brute force finds."""
    r = random.Random(int(100 * rate))
    items = [(i, prose(40, 300 + i)) for i in range(60)]
    docs, able = [], set()
    for i, t in items:
        out = []
        for w in t.split():
            out += [w] if r.random() >= rate else r.choice((["edited"], [], [w, "edited"]))
        docs.append((i, f"{prose(60, i)} {' '.join(out)} {prose(60, 800 + i)}"))
        block = decontamination.Block([(i, t)])
        ids = decontamination.WordIds(block.vocabulary).of(docs[-1][1])
        if decontamination.smith_waterman(block.items[i], ids)[0] >= decontamination.MIN_SCORE * 2 * len(block.items[i]):
            able.add((i, i))
    got = leaks(spark, items, docs).keys() & able
    assert len(able) >= 30 and len(got) >= 0.9 * len(able)


def test_bound_is_never_below_the_alignment():
    r = np.random.default_rng(3)
    for _ in range(200):
        block = decontamination.Block([(1, " ".join(map(str, r.integers(0, 12, r.integers(3, 30)))))])
        aligned = decontamination.Aligned(block, 0.4)
        ids = decontamination.WordIds(block.vocabulary).of(" ".join(map(str, r.integers(0, 16, r.integers(1, 60)))))
        assert aligned.bound(1, ids) >= aligned.align(1, ids)[0]


def test_words_of_the_block_are_never_forgotten(monkeypatch):
    """More distinct words than a task remembers, ASCII and others, before and between copies of items."""
    monkeypatch.setattr(decontamination, "CACHE", 20)
    block = decontamination.Block([(1, "Ärger über Öl und Gas heute"), (2, "plain words only in this one")])
    ids_of = decontamination.WordIds(block.vocabulary)
    for k in range(30):
        noise = " ".join(f"wört{k}_{j}é «x{j}»" for j in range(40))
        ids = ids_of.of(f"{noise} «Ärger» über Öl, und Gas heute! {noise} Plain words only in this one.")
        assert ids[ids > 0].tolist() == [*block.items[1], *block.items[2]]


def test_rarity_decides_nothing(spark):
    """With every seed rare, with none rare, and by counts: the same rows."""
    items = [(i, prose(30, 40 + i)) for i in range(5)]
    docs = [(100 * i + k, f"{prose(50, 7 * k)} {' '.join(t.split()[:12 + k])} {prose(50, 9 * k)} {t if k == 3 else ''}") for i, t in items for k in range(6)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(map(tuple, decontamination.find_leaks(d, spark.createDataFrame(items, "item_id long, text string")).collect()))
    for rare in ({}, None):
        block = decontamination.Block(items)
        block.rare = {i: set(range(len(block.seeds))) for i, _ in items} if rare is None else rare
        ids_of, aligned, got = decontamination.WordIds(block.vocabulary), decontamination.Aligned(block, decontamination.MIN_SCORE), []
        for doc, text in docs:
            ids = ids_of.of(text)
            got += [(doc, item, *found) for item, ps in block.passages(ids, *block.hits(ids)) if (found := aligned.best(item, ps))]
        assert sorted(got) == want and want


def test_tokens_that_are_not_decoded_could_not_be_marked(language_model):  # noqa: F811
    """The scorer's shortcut against decoding everything, over disguises of sure words and other tokens."""
    r = random.Random(9)
    lexicon = toxicity.Lexicon([])
    lexicon.sure = {"=idiot": 0.9, "=fool": 0.8, "stupi": 0.7, "=loser": 0.9, "=illegal": 0.9, "scum": 0.6}
    marked, full = toxicity.Marked(toxicity.Restored(language_model), lexicon), toxicity.Restored(language_model)
    looks = {"o": "0", "i": "1!|", "l": "1|", "e": "3", "a": "4@", "s": "5$", "t": "7+", "g": "69"}
    seen = 0
    for _ in range(600):
        w = r.choice(["idiot", "fool", "stupid", "loser", "illegal", "scumbag", "river", "table", "lesson"])
        out = "".join(r.choice(looks[c]) if c in looks and r.random() < 0.3 else c * r.choice((1, 1, 1, 2, 4)) for c in w)
        token = r.choice((out, "-".join(out), out.upper(), out + "!!", "*" + out, " ".join(out)))
        want = {x for x in toxicity.restored_words(token, full) if lexicon.score(x)}
        assert marked.of(token) == want
        seen += bool(want)
    assert seen > 150
    assert marked.of("you lo se r there") == {"loser"} and marked.of("you lo ser there") == set()
