import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from procura.llm import queries, tokencounts

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = (
    [" ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "a", "the", "ing", "1", "12", " é", "Ñ", "<|endoftext|>", "<|endof", "text|>"]
    + ["!", "--", "----", "======", "aaaa", "　", "\xa0", "😀", "\x00", "word" * 5, "中文字", "한국", "x̂", "٣", "²", "\x85", "᠎"]
)


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def mixed(n, longest=30, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("limit", [3, 500, 150_000])
def test_counts_equal_the_library_with_any_number_of_states(library, limit):
    texts = mixed(1500) + ["a" * 1000, "-" * 999, " " * 777, "中" * 500, "", "'", "'r", "x'", "<|endoftext|"]
    assert tokencounts.Transducer(PATH, limit).count(pa.array([*texts, None])).tolist() == library([*texts, ""])


def test_texts_of_one_batch_do_not_touch(library):
    texts = ["a <|endof", "text|>", "'", "s", "x", "'", "re", " ", " b", "\n", "\n"]
    assert tokencounts.machine(PATH).count(pa.array(texts)).tolist() == library(texts)


@pytest.fixture(scope="module")
def long_texts():
    rng = random.Random(3)
    pools = [rng.choices(PARTS, k=rng.randint(1, 4)) for _ in range(60)]
    return ["".join(rng.choices(pool, k=rng.randint(100, 1500))) for pool in pools] + ["a" * 5000, "=" * 3333, " " * 2000, "'s" * 1000, "<|endoftext|>" * 90]


def test_chunk_maps_compose_to_the_whole_text(spark, library, long_texts):
    texts = long_texts + mixed(50) + [None, ""]
    df = spark.createDataFrame([(i, t, 9, "c") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, key string")
    for chunk in (301, 500, 20_000):
        found = tokencounts.count(df, PATH, chunk)
        assert found.columns == ["doc_id", "key", "n_bytes", "n_tokens"]
        rows = {r.doc_id: (r.key, r.n_bytes, r.n_tokens) for r in found.collect()}
        assert rows == {i: ("c", len((t or "").encode()), n) for i, (t, n) in enumerate(zip(texts, library(texts)))}


def test_any_grouping_of_chunks_gives_one_map(long_texts):
    machine = tokencounts.machine(PATH)
    names = ("back", "token", "to_back", "to_token", "n")
    for text in long_texts[:40]:
        cuts = [*range(0, len(text), 400), len(text)]
        if machine.splitter.specials(text):
            continue
        maps = [
            [dict(zip(names, m)) for m in machine.chunk_map(text[max(a - 300, 0) : a], text[a:b], text[b : b + 40], a == 0, b == len(text))]
            for a, b in zip(cuts, cuts[1:])
        ]
        half = len(maps) // 2
        parts = [tokencounts.compose(m) for m in (maps[:half], maps[half:]) if m]
        assert tokencounts.compose(parts) == tokencounts.compose(maps)
        assert len(tokencounts.compose(maps)) == 1


def test_query(spark, library, tmp_path):
    texts = [*mixed(20), None, "", "long words " * 90_000, "x" * 200_000]
    rows = [(i % 7 if i % 7 else None, t, i) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, n_bytes int").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op12_token_counts(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    expected = [(r[0], len((t or "").encode()), n, n > 1024) for r, t, n in zip(rows, texts, library(texts))]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, expected))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tokencounts.count(empty, PATH).collect() == []
