import hashlib

import public_tokenizers
import pytest
import sentencepiece
from test_minhash import brute

import corpus_pipeline
from procura.llm import decontaminate, pii, queries, toxicity

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What every stage gets and gives, by name."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    for name, function in corpus_pipeline.STAGES:
        before = docs
        path = str(tmp_path_factory.mktemp(name) / "out")
        function(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = before, docs
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns_stay_until_the_last_stage(spark, kept):
    for name, (before, after) in kept.items():
        if name != "sentencepiece":
            assert before.dtypes == after.dtypes


def test_toxic_documents_go(spark, kept):
    before, after = kept["toxicity"]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.score(before, labels).filter("toxic").collect()}
    assert ids(after) == ids(before) - toxic


def test_one_document_of_each_group_stays(kept):
    before, after = kept["minhash_near_dedup"]
    groups = brute([(r.doc_id, r.text) for r in before.collect()], 80)
    assert ids(after) == {i for i, (_, component) in groups.items() if i == component}


def test_contaminated_documents_go(spark, kept):
    before, after = kept["decontamination"]
    items = [r.text.lower() for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    held = {r.doc_id for r in before.collect() if any(x in r.text.lower() for x in items)}
    assert held <= ids(before) - ids(after)
    found = {r.doc_id for r in decontaminate.contaminations(before, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()}
    assert ids(after) == ids(before) - found


def test_personal_data_is_replaced_and_counted(kept):
    before, after = kept["pii"]
    expected = {r.doc_id: r.text for r in pii.pseudonymise(before, queries.PII_KEY).collect()}
    assert {r.doc_id: r.text for r in after.collect()} == expected
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_ids_and_digests(kept):
    before, after = kept["sentencepiece"]
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        wanted = model.encode(texts[r.doc_id])
        assert r.ids == wanted and r.n_tokens == len(wanted)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, wanted)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(model.decode(wanted).encode()).hexdigest()


def test_run_gives_the_rows_of_the_stages(spark, kept):
    assert ids(corpus_pipeline.run(spark, FOLDER)) == ids(kept["sentencepiece"][1])


def test_nulls_and_an_empty_table_pass_every_stage(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", None, None, 0), (-2, None, "en", "s", None)], docs.schema)
    for rows, n in ((odd, 3), (docs.limit(0), 0)):
        for _, function in corpus_pipeline.STAGES:
            rows = spark.createDataFrame(function(spark, rows, FOLDER).collect(), function(spark, rows, FOLDER).schema)
            assert rows.count() == n
