import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from procura.llm import periods, queries


def brute(words):
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            smaller = any(q % d == 0 and all(words[k] == words[k + d] for k in range(i, j + q - d)) for d in range(1, q))
            if j > i and j + q - i >= max(6, 4 * q) and not smaller:
                found.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repetitive(rng):
    letters = "abcdé"[: rng.randint(1, 5)]
    words = [rng.choice(letters) for _ in range(rng.randint(0, 50))]
    for _ in range(rng.randint(0, 3)):
        period = [rng.choice(letters) for _ in range(rng.randint(1, 9))]
        place = rng.randint(0, len(words))
        words[place:place] = (period * 9)[: rng.randint(3, len(period) * 8)]
    return words


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(40):
        texts = [rng.choice([" ", "\n", "\t \r\x0b\x0c"]).join(repetitive(rng)) for _ in range(rng.randint(1, 9))]
        texts += rng.choices(texts, k=3)
        sizes, runs, left = periods._answer(pa.array(texts))
        for text, n, own, rest in zip(texts, sizes.to_pylist(), runs.to_pylist(), left.to_pylist()):
            words = text.split()
            expected = brute(words)
            assert n == len(words) and [(r["start"], r["length"], r["period"]) for r in own] == expected
            assert rest == collapsed(words, expected)


def test_answers_do_not_depend_on_hashes(monkeypatch):
    monkeypatch.setattr(periods, "mix", lambda h: np.zeros_like(h))  # every two stretches collide
    rng = random.Random(5)
    for _ in range(20):
        words = repetitive(rng)
        _, runs, _ = periods._answer(pa.array([" ".join(words)]))
        assert [(r["start"], r["length"], r["period"]) for r in runs.to_pylist()[0]] == brute(words)


def test_grammar_derives_the_words():
    rng = random.Random(7)
    texts = [repetitive(rng) for _ in range(30)]
    texts += texts[:10]
    flat = [w for t in texts for w in t]
    ids = np.unique(flat, return_inverse=True)[1]
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    borders, seen = set(), 0
    for rules in periods.grammar(ids, owner):
        for start, left, length, rule in zip(*[x.tolist() for x in rules[:4]]):
            first = int(rules.start[rules.example[rule]])
            assert flat[start : start + length] == flat[first : first + length] and owner[start] == owner[start + length - 1]
            borders.add(start + left)
        seen += len(rules.start)
    inner = {i for i in range(1, len(flat)) if owner[i] == owner[i - 1]}
    assert borders == inner and seen == len(inner)  # every border between two words belongs to one occurrence


def test_very_long_texts():
    cases = {"a": 1, "a b": 1, "x " * 50 + "y": None}
    for unit, count in cases.items():
        words = (unit + " ") * (300_000 // len(unit.split()))
        runs = periods._answer(pa.array([words]))[1].to_pylist()[0]
        assert runs[0]["start"] == 0 and (count is None or len(runs) == count)
    longest = max(runs, key=lambda r: r["length"])
    assert longest == {"start": 0, "length": 51 * (300_000 // 51), "period": 51}


def planted(doc_id, text):
    words = (text or "").encode().split()
    words, n = [w.decode() for w in words], len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_query(spark, tmp_path):
    rng = random.Random(2)
    texts = [" ".join(repetitive(rng)) for _ in range(300)] + [None, "", " \n", "one", "　 \xa0 　", "go " * 40]
    rows = [(rng.choice([i, -i, None if i % 17 == 0 else i]), t, f"r{i}") for i, t in enumerate(texts)]
    rows += [(r[0], r[1], "again") for r in rows[:20]]
    spark.createDataFrame(rows, "doc_id long, text string, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periods(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = []
    for doc_id, text, _ in rows:
        words = planted(doc_id, text)
        runs = brute(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) + () if runs else (None, None, None)
        milli = 1000 * best[1] // best[2] if runs else None
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        expected.append((doc_id, len(runs), *best, milli, sha(lines), sha(collapsed(words, runs))))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))


def test_other_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a " * 6, 3, "x"), (None, None, None, None)], "doc_id long, text string, row int, n_words string")
    found = periods.find(df)
    assert found.columns == ["doc_id", "row", "n_words", "runs", "collapsed"]
    assert sorted((r.row or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found.collect()) == [(0, 0, [], ""), (3, 6, [(0, 6, 1)], "a")]
    assert periods.find(df.select("text").limit(0)).collect() == []
