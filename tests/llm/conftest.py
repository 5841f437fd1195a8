import pytest

WORDS = "amber birch cedar delta ember fjord grove haven inlet jetty knoll ledge maple north ochre plume quill ridge slate thorn".split()


def prose(n, seed, words=WORDS):
    """n words of simple text with sentence ends, the same for the same seed."""
    import random
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = r.choice(words) + str(r.choice(words))
        out.append(w + ("." if i % 9 == 8 else ""))
    return " ".join(out)


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Null ids and texts, empty and very long texts, repeated rows, ids beyond 2**53, extra columns with clashing names."""
    long_text = "\n".join(prose(60, 1000 + i) for i in range(700))
    rows = [(1, prose(120, 1)), (2, prose(120, 1)), (2, prose(120, 1)), (3, ""), (4, None), (None, prose(120, 2)), (None, None), (None, prose(120, 2)),
            (5, "   \n\n \t"), (6, "one"), ((1 << 60) + 1, prose(90, 3)), (8, long_text), (9, long_text + " end"), (10, "be " * 400), (11, prose(200, 4) + "\n" + prose(60, 1))]
    return spark.createDataFrame([(d, t, "en", None, None, "x", 7, "k", 1.5) for d, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, h string, score int, kept string, votes double")


@pytest.fixture(scope="session")
def no_docs(spark, edge_docs):
    return edge_docs.where("false")
