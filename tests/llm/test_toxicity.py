import functools
import random

import numpy as np
import pyarrow as pa

from procura.llm import toxicity


def corpus(n, seed):
    rng = random.Random(seed)
    parts = ["lo", "we", "ri", "ta", "mu", "ke", "so", "pi"]
    word = lambda: "".join(rng.choices(parts, k=rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.choice([20, 60, 400]))]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(rng.randint(1, 5)):
                bad = rng.choice(["Idiot,", "scum", "moron.", "zargh" + word(), "zargh" + word()])
                words.insert(rng.randrange(len(words)), bad)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_documents_are_told_apart(spark):
    docs, labels = corpus(1500, 1)
    truth = {i: bool(t) for i, _, t in labels}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame(labels[:900], "doc_id long, quality int, toxic int")
    rows = [r for r in toxicity.score(df, known).collect() if r.doc_id >= 900]
    hits = sum(r.toxic and truth[r.doc_id] for r in rows)
    assert hits >= 0.97 * sum(truth[r.doc_id] for r in rows)
    assert sum(r.toxic and not truth[r.doc_id] for r in rows) <= 2


def test_later_links_see_out_of_fold_probabilities_of_earlier_ones():
    rng = np.random.default_rng(0)
    row, column = np.arange(600), rng.integers(0, 40, 600)
    labels = np.column_stack([column < 10, column < 10, (column < 10) | (column > 35)]).astype(int)
    chain, threshold = toxicity.fit_chain(row, column, labels)
    assert [len(w) - toxicity.FEATURES for w in chain] == [1, 2, 3] and 0.3 <= threshold <= 0.9
    assert chain[1][toxicity.FEATURES] > 0
    scores = toxicity.apply_chain(chain, row, column, 600)
    assert ((scores > 0.5) == labels).mean() > 0.99


def test_slots_are_words_and_prefixes_once_a_row():
    buffer = toxicity.buffer_of(pa.array(["Loser, loser! LOSER", "losers", "", None]))
    rows, slots = toxicity.document_slots(buffer)
    by_row = [set(slots[rows == i].tolist()) for i in range(4)]
    assert len(by_row[0]) == 3 and len(by_row[1]) == 4 and not by_row[2] and not by_row[3]
    assert len(by_row[0] & by_row[1]) == 2  # the prefixes of three and four letters; five letters is the word itself


def test_nulls_one_class_and_foreign_columns(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "idiot", "c"), (4, "fine words", "d"), (4, "fine words", "d")], "doc_id long, text string, p_toxic string")
    labels = spark.createDataFrame([(4, 1, 0), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.score(df, labels).collect()
    assert len(rows) == 5 and not any(r.toxic for r in rows)
    some = spark.createDataFrame([(4, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    more = df.union(spark.createDataFrame([(5, "idiot", "e")], df.schema))
    scored = {r.doc_id: r.toxic for r in toxicity.score(more, some).collect()}
    assert not scored[1] and not scored[2]
    assert toxicity.score(df.limit(0), labels.limit(0)).collect() == []


def test_quality_is_a_link_of_its_own_and_may_be_unknown(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(900):
        poor, toxic = rng.random() < 0.3, rng.random() < 0.2
        docs.append((i, " ".join(rng.choices(words, k=40) + ["junkword"] * poor + ["vileword"] * toxic)))
        labels.append((i, None if i % 5 == 0 else int(not poor), int(toxic)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r.doc_id: r for r in toxicity.score(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    for (i, text), (_, _, toxic) in zip(docs, labels, strict=True):
        assert rows[i].toxic == bool(toxic) and (rows[i].p_quality > 0.5) == ("junkword" not in text)
    seeded = toxicity.score(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), seeds={"vile": ["vileword"]})
    assert seeded.columns == ["doc_id", "text", "p_vile", "p_quality", "p_toxic", "toxic"]
    assert all((r.p_vile > 0.5) == r.toxic == ("vileword" in r.text) for r in seeded.collect())


def chain_by_definition(columns, chain, text):
    """Probabilities of one text from the weights: every word, and its prefixes of 3 to 6 letters, once."""
    words = set("".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split())
    used = {(word[: size or len(word)], size) for word in words for size in (0, 3, 4, 5, 6) if size == 0 or len(word) > size}
    known = [c for c in {int(columns[slot_of(*u)]) for u in used} if c >= 0]
    seen = []
    for weights in chain:
        z = sum(weights[c] for c in known) + sum(p * w for p, w in zip(seen, weights[toxicity.FEATURES :], strict=False)) + weights[-1]
        seen.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
    return seen


@functools.cache
def slot_of(text, size):
    """The slot of one word (size 0) or prefix."""
    (words,) = toxicity.windows(toxicity.buffer_of(pa.array([text])), toxicity.ALNUM)
    return (int(words.hashes()[0] ^ np.uint64(size)) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - toxicity.SLOT_BITS)


def test_the_query_scores_as_the_weights_say(spark, tmp_path):
    from procura.llm import queries

    docs, labels = corpus(400, 3)
    docs += [(1000, "idiot " * 30_000 + "scum"), (1001, None), (1002, " \n")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, chain, threshold = toxicity.train(df, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    rows = {r.doc_id: r for r in queries.op1_toxicity(spark, str(tmp_path)).collect()}
    assert len(rows) == len(docs) and rows[1000].toxic and rows[1001].p_toxic == rows[1002].p_toxic == 0
    for i, text in docs[::7] + docs[400:401]:
        want = chain_by_definition(columns, chain, text)
        assert np.allclose([rows[i].p_quality, rows[i].p_toxic], want, atol=1e-9) and rows[i].toxic == (want[-1] >= threshold)
