"""Rows that share an id but hold different texts, in the Jaccard join."""

import random

from millrace.llm import jaccard

from .test_jaccard_rounds import brute


def test_ids_with_several_texts(spark):
    dice = random.Random(11)

    def words(n, kinds=100_000):
        return [f"w{dice.randrange(kinds)}" for _ in range(n)]

    def near(base):
        return [*base[:-1], f"x{dice.randrange(100_000)}"]

    shared, other, pairs = words(120), words(120), [words(60) for _ in range(6)]
    rows = [(7, words(400)), (7, near(shared)), (8, shared), (9, near(other)), (3, other), (3, words(121)), (20, words(50)), (20, []), (21, words(30)), (7, words(121))]
    for k, base in enumerate(pairs):  # two texts of equal size with one id, each linked elsewhere: a chain of ids
        rows += [(30 + k, base), (31 + k, near(base))]
    texts = [(i, " ".join(w)) for i, w in rows] + [(40, None), (40, "a b c d"), (None, "a b c d")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similarity_classes(df, words=3, percent=90).collect()), key=repr)
    sets = brute([(k, t or "") for k, (_, t) in enumerate(texts)], 3, 90)
    component = {i: i for i, _ in texts}
    for _ in texts:  # the least id over links and shared ids, until nothing changes
        for k, (i, _) in enumerate(texts[:-1]):
            for m, (j, _) in enumerate(texts[:-1]):
                if sets[k][0] and sets[k][1] == sets[m][1]:
                    component[i] = component[j] = min(component[i], component[j])
    assert component[8] == 7 and component[9] == 3 and component[36] == 30 and component[20] == 20
    assert got == sorted(((i, sets[k][0], component[i]) for k, (i, _) in enumerate(texts)), key=repr)
