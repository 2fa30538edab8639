import random
import re

import numpy as np

from procura.llm import minhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs, threshold):
    sets = {i: shingle_set(t) for i, t in docs if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    passage = [word() for _ in range(30)]
    docs = []
    for family in range(12):
        base = [word() for _ in range(rng.choice([8, 40, 150]))] + (passage if family % 3 == 0 else [])
        docs.append(" ".join(base))
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = word()
            docs.append((" " if rng.random() < 0.5 else "\n").join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    return [(1000 - i, t) for i, t in enumerate(docs)]


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_families_match_all_pairs(spark):
    docs = corpus()
    for threshold in (85, 80):
        found = result(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), threshold))
        assert found == {i: (n, c, i == c) for i, (n, c) in brute(docs, threshold).items()}


def test_many_members_and_a_shared_passage_lose_no_link(spark):
    rng = random.Random(9)
    passage = " ".join("".join(rng.choices("abcdef", k=5)) for _ in range(60))
    docs = [(i, passage + " " + " ".join("".join(rng.choices("abcdef", k=5)) for _ in range(rng.randint(5, 25)))) for i in range(150)]
    assert {i: c for i, (_, c, _) in result(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))).items()} == {i: c for i, (_, c) in brute(docs, 85).items()}


def test_nulls_short_texts_ties_and_foreign_columns(spark):
    docs = [(3, None), (4, ""), (5, " \n"), (6, "one two"), (2, "ONE  two"), (7, "one"), (8, "a b c d e"), (8, "a b c d e"), (None, "a b c d e"), (9, "a b c d e")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, component string, rep int")
    rows = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=str)
    assert rows == sorted(
        [(3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 2, False), (2, 1, 2, True), (7, 1, 7, True), (8, 1, 8, True), (8, 1, 8, True), (9, 1, 8, False), (None, 1, None, True)],
        key=str,
    )
    assert minhash.near_duplicates(df.limit(0)).collect() == []


def test_densified_signatures_estimate_the_similarity():
    rng = np.random.default_rng(0)
    shared, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (80, 10, 10))
    values = np.concatenate([shared, a, shared, b])
    least = minhash.signatures(values, np.repeat([0, 1], 90), 2)
    assert abs((least[0] == least[1]).mean() - 0.8) < 0.15
    assert not (least == np.iinfo(np.uint64).max).any()


def test_a_hub_joins_thousands_of_spokes_that_are_unlike_each_other(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base = [word() for _ in range(154)]
    docs = [(5000, " ".join(base))]
    for i in range(2000):
        copy = list(base)
        for at in rng.sample(range(10, 140), 2):
            copy[at] = word()
        docs.append((i, " ".join(copy)))
    found = {r.component_id for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == {0}


def test_links_that_no_star_shows_are_found_in_full(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base, docs = [word() for _ in range(150)], []
    for i in range(0, 600, 2):
        copy = list(base)
        for at in rng.sample(range(150), 4):
            copy[at] = word()
        docs.append((i, " ".join(copy)))
        copy[rng.randrange(150)] = word()
        docs.append((i + 1, " ".join(copy)))
    found = {i: c for i, (_, c, _) in result(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))).items()}
    assert found == {i: c for i, (_, c) in brute(docs, 85).items()}
