"""The operators as queries over the given tables: name -> function of (spark, folder)."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procura.llm import chat, decontaminate, embeddings, manifest, minhash, periods, pii, secrets, sentencepieces, tokencounts, toxicity, urls, webpages

#: A stand-in for the secret that a deployment keeps elsewhere.
PII_KEY = "public test key"


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = toxicity.score(_read(spark, folder, "documents").select("doc_id", "text"), _read(spark, folder, "labels"))
    return scored.drop("text")


def op2_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(_read(spark, folder, "embeddings"))


#: Verdict and rule, as host/path.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op3_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(_read(spark, folder, "pages").select("page_id", "url"), URL_RULES)


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    """doc_id, the digests of ids and decoded, and other columns wanted."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        *more,
    )


def op4_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").select("doc_id", "text")
    return digests(sentencepieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model")))


def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find(_read(spark, folder, "documents"))
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    return found.select(
        "doc_id",
        *[count(kind) for kind in ("assign", "access", "hex")],
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"),
    )


def op6_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, folder, "documents"), 85)


def op7_html(spark: SparkSession, folder: str) -> DataFrame:
    return webpages.extract(_read(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminations(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))


def op9_chat(spark: SparkSession, folder: str) -> DataFrame:
    turns = _read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(
        "select * from values (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)"
    )
    back = chat.read_back(chat.format_conversations(turns.union(probe)))
    spoken = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(spoken, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.pseudonymise(_read(spark, folder, "documents").select("doc_id", "text"), PII_KEY)


#: Fields of a document's leaf, in their order.
LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").select(*LEAF)
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = F.when(chosen, manifest.leaf_digest([F.col(c) if c != "text" else lowered for c in LEAF]))
    proofs = manifest.manifest(docs.withColumn("changed", changed), LEAF, "lang", "doc_id", ("changed",))
    folded = manifest.fold(F.coalesce("changed", "leaf"), F.col("path"))
    return proofs.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root")
    )


#: Documents with more tokens are over the limit.
TOKEN_LIMIT = 1024


def op12_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").select("doc_id", "text")
    counted = tokencounts.count(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text; from a place on, one document in ten repeats its own words (joined by one space)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    drawn = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, words).alias("words")).withColumn("n", F.size("words"))
    drawn = drawn.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    drawn = drawn.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    repeated = F.expr("concat(slice(words, 1, a), slice(flatten(array_repeat(slice(words, a + 1, p), cast((n - a + p - 1) div p as int))), 1, n - a))")
    return drawn.select("doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op13_periods(spark: SparkSession, folder: str) -> DataFrame:
    found = periods.find(with_planted_repeats(_read(spark, folder, "documents")))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


REGISTRY = {
    f.__name__: f
    for f in (op1_toxicity, op2_embeddings, op3_urls, op4_sentencepiece, op5_secrets, op6_minhash, op7_html, op8_decontamination, op9_chat, op10_pii, op11_merkle, op12_token_counts, op13_periods)
}
#: DuckDB: crc32 of the decimal doc_id, unsigned.
_CRC = """xor(4294967295, list_reduce([ascii(c) for c in string_split(doc_id::varchar, '')], lambda a, c: list_reduce([0, 1, 2, 3, 4, 5, 6, 7],
    lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(a, c::bigint)), 4294967295::bigint))"""
SQL = {
    "op2_embeddings": """
with recursive v as (select vec_id, [x::double for x in embedding] as e from embeddings),
u as (
  select vec_id, e, sqrt(list_dot_product(e, e)) as n from v
  where len(e) > 0 and len([x for x in e if x is null or not isfinite(x)]) = 0 and len([x for x in e if x <> 0]) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from u as a join u as b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from reach as r join links as l on r.b = l.a)
select v.vec_id, (select count(*) from links where links.a = v.vec_id) as n_links,
  (select min(b) from reach where reach.a = v.vec_id) as component_id,
  v.vec_id = (select min(b) from reach where reach.a = v.vec_id) as kept
from v""",
    "op6_minhash": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
s as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else [array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)] end) as s from w),
x as (select doc_id, len(s) as n, unnest(s) as g from s),
links as (
  select a.doc_id as a, b.doc_id as b from x as a join x as b on a.g = b.g and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from reach as r join links as l on r.b = l.a),
least as (select a, min(b) as b from reach group by a)
select doc_id, len(s)::bigint as n_shingles, b as component_id, doc_id = b as kept from s join least on a = doc_id""",
    "op11_merkle": """
with recursive d as (
  select *, {crc} % 3 = 0 as chosen,
    case when text is null then '-' else strlen(text) || ':' || text end as t,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low,
    coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as f from documents),
leaves as (
  select row_number() over (order by lang nulls first, doc_id nulls first, sha256(f || t)) as id, doc_id, lang, sha256(f || t) as leaf,
    case when chosen then sha256(f || case when text is null then '-' else strlen(low) || ':' || low end) else sha256(f || t) end as used,
    row_number() over (partition by lang order by doc_id nulls first, sha256(f || t)) - 1 as p, count(*) over (partition by lang) as n from d),
tree(g, l, p, n, h) as (
  select lang, 0, p, n, leaf from leaves
  union all
  select g, l + 1, p // 8, (n + 7) // 8, sha256(string_agg(h, '' order by p)) from tree where n > 1 group by g, l, p // 8, n),
sub as (select g, l, h, row_number() over (order by g nulls first) - 1 as p, count(*) over () as n from tree where n = 1),
top(l, p, n, h) as (
  select 0, p, n, h from sub
  union all
  select l + 1, p // 8, (n + 7) // 8, sha256(string_agg(h, '' order by p)) from top where n > 1 group by l, p // 8, n),
step as (
  select x.id, t.l, coalesce(string_agg(t.h, '' order by t.p) filter (t.p < (x.p // (8 ** t.l)::bigint)), '') as a,
    coalesce(string_agg(t.h, '' order by t.p) filter (t.p > (x.p // (8 ** t.l)::bigint)), '') as b
  from leaves as x join tree as t on t.g is not distinct from x.lang and t.n > 1 and t.p // 8 = x.p // (8 ** (t.l + 1))::bigint
  group by x.id, x.p, t.l
  union all
  select x.id, s.l + t.l, coalesce(string_agg(t.h, '' order by t.p) filter (t.p < (s.p // (8 ** t.l)::bigint)), ''),
    coalesce(string_agg(t.h, '' order by t.p) filter (t.p > (s.p // (8 ** t.l)::bigint)), '')
  from leaves as x join sub as s on s.g is not distinct from x.lang join top as t on t.n > 1 and t.p // 8 = s.p // (8 ** (t.l + 1))::bigint
  group by x.id, s.l, s.p, t.l),
path as (select id, list({'a': a, 'b': b} order by l) as steps from step group by id),
folded as (
  select x.*, sha256(coalesce(list_reduce([s.a || s.b for s in steps], lambda m, s: m || s, ''), '')) as proof_sha256,
    coalesce(list_reduce(steps, lambda m, s: {'a': sha256(s.a || m.a || s.b), 'b': ''}, {'a': used, 'b': ''}).a, used) as folded_root
  from leaves as x left join path using (id))
select x.doc_id, x.leaf, s.h as subroot, r.h as root, x.proof_sha256, x.folded_root, x.folded_root = r.h as verified
from folded as x join sub as s on s.g is not distinct from x.lang cross join (select h from top where n = 1) as r""".replace("{crc}", _CRC),
    "op13_periods": r"""
with t as (
  select row_number() over () as id, doc_id, {crc} as h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
u as (select *, len(w) as n, h // 10 as g from t),
v as (select *, g % n as a, 1 + (n - g % n) // (3 + g % 8) as p from u where h % 10 = 0 and n > 0),
d as (
  select id, doc_id, n, [w[case when i <= a then i else a + (i - 1 - a) % p + 1 end] for i in range(1, n + 1)] as w from v
  union all select id, doc_id, n, w from u where id not in (select id from v)),
x as (select id, n, unnest(w) as word, generate_subscripts(w, 1) - 1 as i from d),
same as (
  select a.id, b.i - a.i as q, a.i from x as a join x as b on a.id = b.id and a.word = b.word and b.i > a.i and 4 * (b.i - a.i) <= a.n),
island as (select id, q, i, i - row_number() over (partition by id, q order by i) as k from same),
stretch as (select id, q, min(i) as s, max(i) + 1 + q as e from island group by id, q, k having count(*) >= q),
run as (
  select * from stretch as r where e - s >= greatest(6, 4 * q)
    and not exists (select 1 from stretch as z where z.id = r.id and z.q < r.q and r.q % z.q = 0 and z.s <= r.s and z.e >= r.e)),
gone as (select distinct id, unnest(range(s + q, e)) as i from run),
kept as (select x.id, string_agg(x.word, ' ' order by x.i) as c from x left join gone using (id, i) where gone.i is null group by x.id),
found as (
  select id, count(*) as n_runs, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' order by s, q) as lines,
    arg_min({'s': s, 'n': e - s, 'q': q}, {'n': s - e, 's': s, 'q': q}) as best from run group by id)
select doc_id, coalesce(n_runs, 0) as n_runs, best.s as start, best.n as length, best.q as period, 1000 * best.n // best.q as exponent_milli,
  sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(c, '')) as collapsed_sha256
from d left join found using (id) left join kept using (id)""".replace("{crc}", _CRC),
}
