import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from procura.llm import sentencepieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "\n", "▁", "a", "the", "é", "Ñ", "\r", "\t", "<s>", "ing", "▁▁", ".", ",", "1", "　", "😀", "\x00", "();", "word" * 50]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts(n):
    rng = random.Random(n)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(n)] + ["", " ", "\n", " \n", "\n ", "▁", "\x00"]


@pytest.mark.parametrize("limit", [0, 50, 500_000])
def test_ids_equal_the_library_with_any_table_size(model, monkeypatch, limit):
    monkeypatch.setattr(sentencepieces.ChunkTable, "LIMIT", limit)
    table = sentencepieces.ChunkTable(model)
    for n in (300, 500):
        rows = texts(n)
        assert table.encode(pa.array(rows)).to_pylist() == model.encode(rows)


def test_columns_nulls_and_decoding(spark, model):
    rows = texts(200)
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(rows)] + [(None, None, None)], "doc_id long, text string, ids int")
    found = sentencepieces.encode(df, PATH).collect()
    assert len(found) == len(rows) + 1
    for r in found:
        ids = model.encode(r.text or "")
        assert r.ids == ids and r.decoded == model.decode(ids)
    assert sentencepieces.encode(df.limit(0), PATH).collect() == []


def test_chunks_built_to_collide(model):
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    pair = ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
    table = sentencepieces.ChunkTable(model)
    assert table.encode(pa.array([" ".join(pair), *pair])).to_pylist() == model.encode([" ".join(pair), *pair])


def test_a_very_long_text(model):
    text = "The naïve words " * 100_000 + "x" * 50_000
    assert sentencepieces.ChunkTable(model).encode(pa.array([text])).to_pylist() == model.encode([text])


def test_query_digests(spark, model, tmp_path):
    import hashlib

    from procura.llm import queries

    rows = [(i, t) for i, t in enumerate(texts(60))] + [(3, "again"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = [(i, len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids))) for i, t in rows for ids in [model.encode(t or "")]]
    found = queries.op4_sentencepiece(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, expected))
