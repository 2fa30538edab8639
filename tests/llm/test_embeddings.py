import numpy as np
import pytest

from procura.llm import embeddings


def brute(ids, vectors, threshold):
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1)[:, None]
    links = unit @ unit.T >= threshold
    np.fill_diagonal(links, False)
    least = ids.copy()
    while True:
        new = np.where(links, least[None, :], least[:, None]).min(axis=1)
        if (new == least).all():
            return links.sum(axis=1), least
        least = np.minimum(least, new)


@pytest.mark.parametrize("tile", [16, 2048])
def test_links_match_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "TILE", tile)
    rng = np.random.default_rng(tile)
    centres = rng.normal(size=(9, 12))
    vectors = (centres[rng.integers(0, 9, 300)] + rng.normal(size=(300, 12)) * rng.choice([0.05, 0.3, 1.0], size=(300, 1))).astype(np.float32)
    vectors[50:80] = vectors[3]
    ids = rng.permutation(300)
    df = spark.createDataFrame([(int(i), v.tolist(), "x") for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<float>, rep string")
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, 0.9).collect()}
    n, least = brute(ids, vectors, 0.9)
    assert found == {int(i): (int(k), int(c), i == c) for i, k, c in zip(ids, n, least, strict=True)}


def test_error_bound_holds_and_few_pairs_are_recomputed():
    rng = np.random.default_rng(2)
    unit = embeddings.unit_rows(rng.normal(size=(200, 64)))
    values, scale, error = embeddings.quantise(unit)
    rough = (values * scale[:, None]) @ (values * scale[:, None]).T
    norm = np.linalg.norm(values * scale[:, None], axis=1)
    assert (np.abs(rough - unit @ unit.T) <= np.outer(norm, error) + error[:, None] + 1e-9).all()


def test_bad_vectors_repeats_and_an_empty_table(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0, 0.1]), (7, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (8, [None, 1.0]), (9, []), (1, [1.0, 0.0]), (10, [inf, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()), key=str)
    lone = [(i, 0, i, True) for i in (3, 4, 5, 7, 8, 9, 10)]
    assert found == sorted([(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (6, 3, 1, False), (None, 0, None, True), *lone], key=str)
    assert embeddings.near_duplicates(df.limit(0)).collect() == []
