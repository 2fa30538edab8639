import hashlib
import random
import zlib

import pytest

from procura.llm import manifest, queries

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """Root of the nodes and each one's siblings on the way up, as (left, right)."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(places):
            run = p // 8 * 8
            paths[i].append(("".join(nodes[run:p]), "".join(nodes[p + 1 : run + 8])))
        nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        places = [p // 8 for p in places]
    return nodes[0], paths


def expected(rows):
    key = lambda v: (v is not None, v.encode() if isinstance(v, str) else v if v is not None else 0)
    groups = sorted({r[2] for r in rows}, key=key)
    members = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (*key(r[0]), leaf(r))) for g in groups}
    trees = {g: tree([leaf(r) for r in members[g]]) for g in groups}
    root, tops = tree([trees[g][0] for g in groups])
    found = []
    for g, top in zip(groups, tops):
        for r, below in zip(members[g], trees[g][1]):
            path = below + top
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            at = leaf((*r[:4], text))
            for left, right in path:
                at = sha(left + at + right)
            found.append((r[0], leaf(r), trees[g][0], root, sha("".join(a + b for a, b in path)), at, at == root))
    return sorted(found, key=repr)


def documents(n, langs, seed):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "É", "", " ", "Zz", "0", "😀"]
    pick = lambda: rng.choice([None, "".join(rng.choices(words, k=rng.randint(0, 5)))])
    return [(rng.choice([None, i, -i, i // 2]), pick(), rng.choice(langs), rng.choice([None, 7]), pick()) for i in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        documents(700, [None, "", "a", "b", "é", "Z"], 1),
        documents(90, [f"l{i}" for i in range(80)], 2),
        documents(65, ["one"], 3),
        [(1, "s", "one", 3, "Text")],
        [(1, "s", "one", 3, "Text"), (2, "s", "two", 3, "Text")],
        [(4, "s", None, 3, "A" * 3_000_000)] * 9 + [(None, None, None, None, None)] * 3,
    ],
)
def test_query_equals_the_plain_tree(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_merkle(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(rows)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA + ", h string, t long")
    found = manifest.manifest(empty, FIELDS, "lang", "doc_id", ("h",))
    assert found.columns == ["lang", "doc_id", "h", "leaf", "subroot", "root", "path"] and found.collect() == []
    df = spark.createDataFrame([(1, "s", "x", 1, "t", "own", 5), (2, "s", "x", 1, "t", "own2", 6)], SCHEMA + ", h string, t long")
    found = manifest.manifest(df, FIELDS, "lang", "doc_id", ("h", "t")).collect()
    assert {(r.doc_id, r.h, r.t) for r in found} == {(1, "own", 5), (2, "own2", 6)}
    first, second = sorted(found, key=lambda r: r.doc_id)
    assert first.root == second.root == sha(first.leaf + second.leaf)
    assert [tuple(s) for s in first.path] == [("", second.leaf)]
