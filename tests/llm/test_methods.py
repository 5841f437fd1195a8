"""Operators against brute force, exact round trips and held-out labels."""

import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from conftest import prose
from hypothesis import given, settings
from hypothesis import strategies as st
from slotwise.llm import arrays, decontamination, line_crf, line_dedup, near_dup, packing, substring_dedup, suffix_dedup, toxicity, urls, weak_labels

SF = "/root/testdata/sf0.001"
SYLLABLES = "ab cd ef gh".split()


@pytest.fixture(scope="module")
def rows(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@given(st.lists(st.integers(0, 2), max_size=60), st.integers(2, 6), st.integers(1, 3))
@settings(max_examples=60, deadline=None)
def test_equal_windows_have_equal_anchors(symbols, length, k):
    k = min(k, length)
    x = arrays.BYTE_CODES[np.array(symbols, dtype=np.uint8)]
    first, last, anchor, h, c = arrays.window_anchors(x, length, k, arrays.Powers())
    seen = {}
    windows = [w for a, b in zip(first, last) for w in range(a, b + 1)]
    assert windows == list(range(max(0, len(symbols) - length + 1)))
    for a, b, p, g in zip(first, last, anchor, h):
        for w in range(a, b + 1):
            assert seen.setdefault(tuple(symbols[w:w + length]), (p - w, g)) == (p - w, g)


def test_blocks_of_a_long_text_cover_every_window(monkeypatch):
    monkeypatch.setattr(arrays, "BLOCK", 50)
    x = arrays.BYTE_CODES[np.frombuffer(prose(200, 5).encode(), np.uint8)]
    first, last, *_ = arrays.window_anchors(x, 30, 10, arrays.Powers())
    assert [w for a, b in zip(first, last) for w in range(a, b + 1)] == list(range(len(x) - 29))


@given(st.lists(st.text("ab", min_size=1, max_size=14), min_size=1, max_size=6), st.lists(st.integers(1, 2), min_size=6, max_size=6))
@settings(max_examples=80, deadline=None)
def test_automaton_counts_like_brute_force(strings, weights):
    a = substring_dedup.SuffixAutomaton()
    for s, m in zip(strings, weights):
        a.add(s, m)
    best = a.repeated()
    for s in strings:
        want = []
        for e in range(1, len(s) + 1):
            n = 0
            for lo in range(e):
                part = s[lo:e]
                times = sum(m * sum(t.startswith(part, i) for i in range(len(t))) for t, m in zip(strings, weights))
                if times > 1:
                    n = e - lo
                    break
            want.append(n)
        assert list(a.matching_statistics(s, best)) == want


@given(st.lists(st.lists(st.binary(max_size=6), max_size=8), min_size=1, max_size=5))
@settings(max_examples=80, deadline=None)
def test_merge_sorts_and_knows_common_prefixes(lists):
    runs = []
    for l in lists:
        shared, sizes, rest, items = suffix_dedup.encode_run([(s, i) for i, s in enumerate(sorted(l))])
        runs.append(suffix_dedup.Run({"shared": shared, "sizes": sizes, "rest": rest, "items": items}))
    out = list(suffix_dedup.merge(runs))
    assert [s for _, s, _ in out] == sorted(s for l in lists for s in l)
    last = b""
    for _, s, n in out:
        assert n == suffix_dedup.common(last, s)
        last = s


@given(st.lists(st.tuples(st.binary(max_size=4), st.binary(max_size=4)), min_size=1, max_size=8, unique=True), st.integers(2, 5))
@settings(max_examples=80, deadline=None)
def test_group_masks(cells, length):
    """Cells as (left, right) of a common anchor of no bytes."""
    cells = sorted(cells, key=lambda c: c[1])
    rights = [0] + [suffix_dedup.common(a[1], b[1]) for a, b in zip(cells, cells[1:])]
    got = suffix_dedup.group_masks([l[::-1] for l, _ in cells], rights, length)
    for i, (l, r) in enumerate(cells):
        want = 0
        for d in range(length + 1):
            if d <= len(l) and length - d <= len(r):
                mine = (l[len(l) - d:], r[:length - d])
                if any(j != i and d <= len(x) and length - d <= len(y) and (x[len(x) - d:], y[:length - d]) == mine for j, (x, y) in enumerate(cells)):
                    want |= 1 << d
        assert got[i] & ((1 << (min(len(l), length) + 1)) - 1) == want


def test_word_windows(spark, rows):
    assert sorted(tuple(r) for r in substring_dedup.op4_suffix_automaton(spark, SF).collect()) == sorted(brute.word_windows(rows))


def test_byte_strings(spark, rows):
    assert sorted(tuple(r) for r in suffix_dedup.op5_suffix_merge_sort(spark, SF).collect()) == sorted(brute.byte_strings(rows))


def test_line_chunks(spark, rows):
    extra = [(1000 + i, t + "\n" + rows[i][1]) for i, (_, t) in enumerate(rows[1:60])]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(df).collect())
    assert got == sorted(brute.line_chunks(rows + extra, line_dedup.DIVISOR))
    assert any(t != u for (_, t), (_, u) in zip(sorted(rows + extra), got))


def test_near_duplicate_classes(spark, rows):
    base = prose(200, 7).split()
    chain = [(5000 + i, " ".join(base[:3 * i] + [f"new{j}" for j in range(3 * i)] + base[6 * i:])) for i in range(6)]
    many = [(6000 + i, " ".join(base[:100] + [f"own{i}"] + base[100:])) for i in range(40)]
    docs = rows + chain + many
    got = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))[0]
    assert {r.doc_id: r.class_id for r in got.collect()} == brute.weighted_jaccard_classes(docs)


def test_samples_agree_as_often_as_sets_are_similar():
    r = np.random.default_rng(1)
    h = np.sort(r.integers(0, 1 << 63, 3000, dtype=np.uint64))
    w = r.uniform(1, 9, 3000).astype(np.float32)
    v = np.where(r.random(3000) < 0.3, w * 0.5, w).astype(np.float32)
    keep = r.random(3000) < 0.9
    want = np.minimum(w, v)[keep].sum() / (np.maximum(w, v)[keep].sum() + w[~keep].sum())
    rates = []
    for salt in range(40):
        g = arrays.mix(h + np.uint64(salt))
        o = np.argsort(g)
        rates.append((near_dup.samples(g[o], w[o]) == near_dup.samples(g[o][keep[o]], v[o][keep[o]])).mean())
    assert abs(np.mean(rates) - want) < 0.04


def test_packing_is_gapless_and_ids_are_those_of_the_tokenizer(spark, rows):
    from tokenizers import Tokenizer
    extra = [(9000, "a <|endoftext|> b"), (9001, "  two  spaces\n\n\t x"), (9002, "日本語 text １２"), (9003, "it's we'll 's 'd"), (9004, "x y z \u0085 q"), (9005, "é \U0001f600 ok")]
    docs = rows + extra
    got = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    tok = Tokenizer.from_file(packing.tokenizer_path())
    ids = {d: np.array(tok.encode(t, add_special_tokens=False).ids + [0], dtype="<u4") for d, t in docs}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(ids)
    for d, pieces in by_doc.items():
        at = 0
        for i, p in enumerate(sorted(pieces, key=lambda p: p.piece)):
            assert (p.piece, p.start) == (i, at) and (i == 0 or p.length == 2048) and p.length <= 2048
            assert p.ids_crc32 == zlib.crc32(ids[d][at:at + p.length].tobytes())
            at += p.length
        assert at == len(ids[d])
    total = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        total += at
    assert len(by_seq) <= 1.15 * total / 2048 + 8


@given(st.lists(st.integers(1, 16), max_size=60), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_best_fit_takes_the_tightest_open_bin(sizes, limit):
    fit = packing.BestFit(16, limit)
    free, fill = {}, {}
    for n in sizes:
        b, at = fit.place(n)
        room = [f for f in free.values() if f >= n]
        if b in free:
            assert free[b] == min(room) and at == 16 - free[b]
        else:
            assert not room and at == 0
            if len(free) >= limit:
                closed = min(free.values())
                free.pop(next(k for k in reversed(list(free)) if free[k] == closed))
            free[b] = 16
        free[b] -= n
        if free[b] == 0:
            free.pop(b)
        fill[b] = fill.get(b, 0) + n
        assert fill[b] <= 16 and sorted(free.values()) == sorted(f for f, s in enumerate(fit.bins) for _ in s)


def test_alignment_matches_plain_dynamic_programme():
    r = np.random.default_rng(3)
    for _ in range(40):
        a, b = r.integers(1, 5, r.integers(1, 12)), r.integers(1, 5, r.integers(1, 15))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                best[i, j] = max(0, best[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), best[i - 1, j] - 1, best[i, j - 1] - 1)
        assert decontamination.smith_waterman(a, b)[0] == best.max()


def test_leaks_are_found_edited_or_not(spark):
    items = [(i, prose(40, 300 + i)) for i in range(12)]
    docs = []
    for i, t in items:
        w = t.split()
        docs.append((100 + i, prose(150, 400 + i) + " " + t + " " + prose(80, 500 + i)))                       # exact
        edited = [x if k % 6 else "edited" for k, x in enumerate(w)]
        docs.append((200 + i, prose(150, 600 + i) + " " + " ".join(edited) + " " + prose(80, 700 + i)))        # every sixth word
        docs.append((300 + i, prose(250, 800 + i)))                                                            # clean
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(d, bench).collect()}
    assert got == {(100 + i, i) for i in range(12)} | {(200 + i, i) for i in range(12)}
    assert got == {(r.doc_id, r.item_id) for r in decontamination.find_leaks(d, bench, block_words=100).collect()}


def test_viterbi_finds_the_best_path():
    from itertools import product
    r = np.random.default_rng(4)
    for n in range(1, 7):
        emit, trans = r.normal(size=(n, 2)), r.normal(size=(2, 2))
        score = lambda p: sum(emit[i, s] for i, s in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:]))
        assert tuple(line_crf.viterbi(emit, trans)) == max(product((0, 1), repeat=n), key=score)


def test_base_counts_and_retention(spark, rows):
    got = {r.doc_id: r for r in line_crf.op1_line_crf(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    wrong = 0
    for d, t in rows:
        w = brute.WORD.findall(t)
        tri = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        hit = {j for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [l for l in t.split("\n") if brute.WORD.search(l)]
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r.kept and r.base_failed)
        wrong += labels.get(d) == 1 and not r.base_failed and not r.kept or labels.get(d) == 0 and r.kept
    assert wrong <= 3


def test_weak_labels_agree_with_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r.kept for r in weak_labels.op9_weak_label_quality(spark, sf).collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    assert sum(got[d] == (q == 1) for d, q in labels) / len(labels) > 0.95


def test_em_recovers_labeller_accuracies():
    r = np.random.default_rng(5)
    truth = r.random(4000) < 0.8
    votes = []
    for t in truth:
        v = []
        for x in weak_labels.LABELLERS:
            v.append("0" if not t and r.random() < 0.4 or t and r.random() < 0.02 else "-" if x[3] is None or r.random() < 0.2 else "1")
        votes.append("".join(v))
    post, rates, good = weak_labels.estimate(Counter(votes))
    assert abs(good - 0.8) < 0.05 and abs(rates[0, 0, 0] - 0.4) < 0.1
    assert np.mean([(post[v] > 0.5) == t for v, t in zip(votes, truth)]) > 0.95


@pytest.fixture(scope="module")
def language_model():
    words = Counter()
    for i in range(50):
        words.update(w.strip(".") for w in prose(200, 900 + i, "idiot moron stupid worthless clown tion the and ing loser".split() + [f"{a}{b}" for a in "ther ing on st".split() for b in "ea at er".split()]).split())
    counts = np.zeros(toxicity.SYMBOLS ** 3)
    for w, n in words.items():
        c = [0, 0, *map(toxicity.code, w), 0]
        for i in range(len(c) - 2):
            counts[(c[i] * 64 + c[i + 1]) * 64 + c[i + 2]] += n
    single = Counter("idiot moron stupid worthless clown loser".split())
    for w in single:
        c = [0, 0, *map(toxicity.code, w), 0]
        for i in range(len(c) - 2):
            counts[(c[i] * 64 + c[i + 1]) * 64 + c[i + 2]] += 300
    return toxicity.log_probabilities(counts)


@pytest.mark.parametrize("seen,word", [("1d10t", "idiot"), ("m0r0n", "moron"), ("$tup1d", "stupid"), ("idiiiiot", "idiot"), ("c-l-o-w-n", "clown"), ("i d i o t", "idiot"), ("l0ser", "loser"), ("w0rthle55", "worthless")])
def test_disguised_words_are_restored(language_model, seen, word):
    assert toxicity.decode(seen, language_model) == word


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    lang = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in toxicity.op2_noisy_channel_toxicity(spark, sf).collect()]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    hit = sum(p for _, p, t in held if t == 1) / sum(t == 1 for _, _, t in held)
    false = sum(p for _, p, t in held if t == 0) / sum(t == 0 for _, _, t in held)
    assert hit > 0.85 and false < 0.02 and len(lang) == len(got)


def test_labels_of_held_out_documents_are_not_read(spark):
    docs = spark.createDataFrame([(i, prose(60, i) + (" vilest" if i % 4 == 0 else "")) for i in range(300)], "doc_id long, text string")
    label = [(i, int(i % 4 == 0)) for i in range(300)]
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in label]
    a, b = (sorted(tuple(r) for r in toxicity.score_toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect()) for x in (label, turned))
    assert a == b and all(p == int(d % 4 == 0) for d, _, _, p in a)


def test_url_rules_match_sql(spark, duck):
    import oracle
    _, msg, n = oracle.compare(spark, duck, urls.op8_association_rules, urls.OP8_SQL, SF)
    assert msg is None, msg
    assert n > 0
