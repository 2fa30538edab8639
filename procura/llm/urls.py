"""URL filter: host and path rules, and a character language-model ratio for all other URLs.

A rule `host/path` fits a host and its subdomains if the URL's path starts with the rule's; the longest rule wins. URLs
that a rule decides are the labelled examples of the model: accepted and rejected, plus hosts with a seed word, which
count as rejected. A rule that blocks only a path says nothing about its host and gives no examples. Two variable-order Markov models over characters (up to `ORDER` characters of context, Witten-Bell
smoothing from each order to the next lower one) give the log-likelihood difference per character of host, path and query.
Masked is only what decides the labels: the last label of the host, labels that a rule names, and, on hosts for which a
rule has a path, as many leading path segments as that rule has.

The limit is calibrated: the difference that at most `false_rejects` of the accepted URLs exceed, each scored by a model
trained on the other half of the hosts. URLs above it are blocked. Examples are distinct texts with digit runs written
as one 0, so a host with a third of all pages weighs no more than another. Counts cover all URLs and are summed in Spark; the
alphabet has `len(ALPHABET) + 1` symbols, so a model is a table of at most 40^4 cells however many URLs there are.

Defined cases: a null URL or one without `://` has empty host and path, no rule, and is allowed; without both classes
of examples every URL is allowed; rows are judged one by one, repeated or not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procura.llm.stage import stage

ORDER = 3
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-./"
SIZE = len(ALPHABET) + 1
#: Words in host names that mark a rejected example.
SEED_WORDS = ("adult", "porn", "xxx", "sex", "casino", "poker", "bets", "pills", "viagra", "spam", "ads", "malware", "phish", "warez")

_CODES = np.zeros(256, dtype=np.int64)
for _i, _c in enumerate(ALPHABET, 1):
    _CODES[ord(_c)] = _CODES[ord(_c.upper())] = _i


def split_url(url: Column) -> tuple[Column, Column]:
    """(host in lower-case ASCII, path); both empty without `://`."""
    after = F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, else null. rules: (verdict, `host/path`)."""
    fits = []
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        rule_host, slash, rest = rule.partition("/")
        inside = (host == rule_host) | host.endswith("." + rule_host)
        fits.append(F.when(inside & path.startswith(slash + rest), F.lit(rule)))
    return F.coalesce(*fits, F.lit(None).cast("string"))


def query_of(url: Column) -> Column:
    """What stands between `?` and `#`; empty without it."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^?#]*\?([^#]*)", 1)


def _scored_text(host: Column, path: Column, query: Column, rules: list[tuple[str, str]]) -> Column:
    """Host, path and query without what decides the labels; a run of digits is one 0."""
    parts = [(rule.partition("/")[0], len([p for p in rule.partition("/")[2].split("/") if p])) for _, rule in rules]
    named = sorted({label for rule_host, _ in parts for label in rule_host.split(".")})
    labels = F.split(host, r"\.")
    shown = F.filter(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(0))), lambda c: ~c.isin(named))
    rest = path
    for depth in sorted({d for _, d in parts if d}):
        there = [(host == h) | host.endswith("." + h) for h, d in parts if d == depth]
        rest = F.when(reduce(Column.__or__, there), F.regexp_replace(path, f"^(?:/[^/]*){{1,{depth}}}", "")).otherwise(rest)
    asked = F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))
    return F.regexp_replace(F.concat(F.lit("."), F.array_join(shown, "."), rest, asked), "[0-9]+", "0")


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbol codes of all texts, each led by ORDER zeros, and where texts start (one more at the end)."""
    rows = [t.encode() for t in texts.to_pylist()]
    pad = bytes(ORDER)
    raw = np.frombuffer(b"".join(pad + r for r in rows), dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(r) + ORDER for r in rows])]).astype(np.int64)
    return _CODES[raw], starts


def _contexts(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table cell (context of ORDER symbols, next symbol) at every real character, and the text it belongs to."""
    places = np.arange(len(codes))
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    real = places - starts[row] >= ORDER
    at = places[real]
    cell = np.zeros(len(at), dtype=np.int64)
    for k in range(ORDER, -1, -1):
        cell = cell * SIZE + codes[at - k]
    return cell, row[real]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts per (fold, rejected, cell), combined within a batch."""
    for batch in batches:
        codes, starts = symbols(batch.column("text"))
        cell, row = _contexts(codes, starts)
        group = batch.column("fold").to_numpy()[row] * 2 + batch.column("rejected").to_numpy(zero_copy_only=False).astype(np.int64)[row]
        keys, n = np.unique(group * SIZE ** (ORDER + 1) + cell, return_counts=True)
        group, cell = np.divmod(keys, SIZE ** (ORDER + 1))
        yield pa.record_batch([pa.array(group // 2), pa.array(group % 2 == 1), pa.array(cell), pa.array(n)], ["fold", "rejected", "cell", "n"])


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """Witten-Bell smoothed log P(next | context) for every cell, from counts of the full order."""
    levels = [counts.reshape((SIZE,) * (ORDER + 1)).astype(np.float64)]
    for _ in range(ORDER):
        levels.append(levels[-1].sum(axis=0))
    p = np.full(SIZE, 1.0 / SIZE)
    for level in reversed(levels):
        total = level.sum(axis=-1, keepdims=True)
        kinds = (level > 0).sum(axis=-1, keepdims=True)
        weight = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0)
        share = np.divide(level, total, out=np.zeros_like(level), where=total > 0)
        p = (1 - weight) * share + weight * np.broadcast_to(p, level.shape)
    return np.log(p).astype(np.float32).ravel()


def _score(tables: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds `ratio`: mean of the table over a text's characters; table `fold` of a row, 0 if there is one table."""
    stacked = np.concatenate(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, starts = symbols(batch.column("text"))
            cell, row = _contexts(codes, starts)
            fold = batch.column("fold").to_numpy()[row] if len(tables) > 1 else 0
            sums = np.bincount(row, stacked[cell + fold * SIZE ** (ORDER + 1)], minlength=len(batch))
            ratio = sums / np.maximum(np.bincount(row, minlength=len(batch)), 1)
            yield pa.record_batch([*batch.columns, pa.array(ratio)], [*batch.schema.names, "ratio"])

    return run


def judge(pages: DataFrame, rules: list[tuple[str, str]], false_rejects: float = 0.02) -> DataFrame:
    """(page_id, host, path, rule, verdict, ratio) per row of `pages` (page_id long, url string)."""
    host, path = split_url(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), query_of(F.col("url").cast("string")).alias("query"))
    text = _scored_text(F.col("host"), F.col("path"), F.col("query"), rules)
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("text", text).drop("query")
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(2)).cast("long"))
    verdicts = F.create_map(*[F.lit(x) for v, r in rules for x in (r, v)]) if rules else F.create_map().cast("map<string,string>")
    rows = rows.withColumn("by_rule", F.try_element_at(verdicts, F.col("rule")))
    seeded = F.arrays_overlap(F.split("host", "[.-]"), F.lit(list(SEED_WORDS)))
    partial = [r for v, r in rules if v == "block" and r.partition("/")[2]]
    telling = F.col("by_rule").isNotNull() & ~F.coalesce(F.col("rule").isin(partial), F.lit(False))
    examples = rows.filter("host <> ''").filter(seeded | telling).select("text", "fold", (seeded | (F.col("by_rule") == "block")).alias("rejected")).distinct()
    counted = stage(
        examples.mapInArrow(_count, "fold long, rejected boolean, cell long, n long").groupBy("fold", "rejected", "cell").agg(F.sum("n").alias("n")), "url-counts"
    )
    tables = _tables(counted)
    if tables is None:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("ratio"))
    limit = _calibrate(examples.filter("not rejected"), tables[1:], false_rejects)
    fields = "page_id long, host string, path string, rule string, text string, fold long, by_rule string, ratio double"
    scored = rows.withColumn("page_id", F.col("page_id").cast("long")).mapInArrow(_score(tables[:1]), fields)
    bad = (F.col("host") != "") & (F.col("ratio") > limit)
    return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(bad, "block").otherwise("allow")).alias("verdict"), "ratio")


def _tables(counted: DataFrame) -> list[np.ndarray] | None:
    """Log-likelihood differences per cell: of the model over all hosts, then without fold 0, then without fold 1."""
    cells = counted.toArrow()
    counts = np.zeros((2, 2, SIZE ** (ORDER + 1)))
    fold, rejected, cell, n = (cells.column(c).to_numpy(zero_copy_only=False) for c in ("fold", "rejected", "cell", "n"))
    counts[fold.astype(int), rejected.astype(int), cell.astype(int)] = n
    if not counts.sum(axis=(0, 2)).all():
        return None
    picked = (counts.sum(axis=0), counts[1], counts[0])
    return [log_probabilities(c[1]) - log_probabilities(c[0]) for c in picked]


def _calibrate(accepted: DataFrame, tables: list[np.ndarray], false_rejects: float) -> float:
    """The least thousandth that at most `false_rejects` of the accepted URLs exceed, held out by host."""
    scored = accepted.select("text", "fold").mapInArrow(_score(tables), "text string, fold long, ratio double")
    steps = scored.groupBy(F.ceil(F.col("ratio") * 1000).alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy("step").collect()
    rest = sum(r["n"] for r in steps)
    allowed = false_rejects * rest
    for r in steps:
        rest -= r["n"]
        if rest <= allowed:
            return r["step"] / 1000
    return 0.0
