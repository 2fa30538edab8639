import random
import re

from procura.llm import decontaminate


def run(spark, docs, items, share=0.5):
    found = decontaminate.contaminations(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), share)
    return {(r.doc_id, r.item_id): r for r in found.collect()}


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(3, 7))) for _ in range(n))


def test_planted_items_are_found_and_clean_documents_left_alone(spark):
    rng = random.Random(2)
    items = [(i, prose(rng, rng.randint(12, 50))) for i in range(40)]
    docs, planted = [], set()
    for d in range(200):
        text = prose(rng, rng.randint(5, 300))
        if d % 4 == 0:
            i, item = rng.choice(items)
            planted.add((d, i))
            text += ". " + (item.upper() if d % 8 == 0 else re.sub(" ", rng.choice([" ", "  ", "\n", ", "]), item)) + " " + prose(rng, 20)
        docs.append((d, text))
    assert set(run(spark, docs, items)) == planted


def test_counts_match_brute_force_on_plain_words(spark):
    rng = random.Random(6)
    items = [(i, prose(rng, 30)) for i in range(8)]
    docs = [(d, prose(rng, 40) + " " + " ".join(items[d % 8][1].split()[: 10 + d])) for d in range(20)]
    found = run(spark, docs, items, 0.01)
    windows = lambda text: [tuple(text.split()[k : k + 10]) for k in range(len(text.split()) - 9)]
    for d, text in docs:
        for i, item in items:
            hits = sum(w in set(windows(text)) for w in windows(item))
            assert (found[d, i].n_hits if (d, i) in found else 0) == hits


ITEM = "If Alice buys 3 apples for 5 dollars each and Bob buys 3 pears what does Alice pay in total today"


def test_reworded_items_need_consistent_slots(spark):
    docs = [
        (1, "Start here. " + ITEM),
        (2, "If Alice buys 7 apples for 5 dollars each and Bob buys 8 pears what does Alice pay in total today"),
        (4, "Well, if Zed buys 4 apples for 9 euros each and Carl buys 4 pears what does Zed pay in total today"),
        (5, "Nothing of the kind is said by Alice in this text about 3 apples"),
    ]
    found = run(spark, docs, [(1, ITEM)])
    assert {k: v.reworded for k, v in found.items()} == {(1, 1): False, (4, 1): True}


def test_accents_capitals_numbers_and_short_items(spark):
    items = [(1, "La Éai éonleeau pour an éonqueê aivi ai éoiré anvitre èenreré été"), (2, "one two three four five six"), (3, "one two"), (4, None), (5, "the value 3.5 and 1,000 lies between many other known numbers of them all")]
    docs = [(1, "LA ÉAI ÉONLEEAU POUR AN ÉONQUEÊ AIVI AI ÉOIRÉ ANVITRE ÈENRERÉ ÉTÉ"), (2, "x. one two three four five six y"), (3, "one two"), (4, None), (5, ""), (6, "the value 9.25 and 2,000 lies between many other known numbers of them all")]
    assert set(run(spark, docs, items)) == {(1, 1), (2, 2), (6, 5)}


def test_repeats_null_ids_empty_tables_and_foreign_columns(spark):
    docs = spark.createDataFrame([(1, ITEM, 1), (1, ITEM, 1), (None, ITEM, 1)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, ITEM, 1), (1, ITEM, 1), (None, ITEM, 1)], "item_id long, text string, size int")
    found = decontaminate.contaminations(docs, items).collect()
    assert [(r.doc_id, r.item_id, r.n_hits, r.n_windows) for r in found] == [(1, 1, found[0].n_windows, found[0].n_windows)]
    assert decontaminate.contaminations(docs.limit(0), items).collect() == []
    assert decontaminate.contaminations(docs, items.limit(0)).collect() == []


def test_items_of_numbers_and_units_are_found_word_for_word(spark):
    table = "12 kg 30 kg 7 cm 19 km 250 ml 3 hours 44 miles 8 weeks add 5 and 6"
    items = [(1, table), (2, "3 + 4 + 5 + 6 + 7")]
    docs = [(1, "see the list: " + table + " end"), (2, "sum 3 + 4 + 5 + 6 + 7 now"), (3, "12 kg of rice and 30 kg of flour"), (4, "3 + 4 + 5 + 6 + 8")]
    found = run(spark, docs, items)
    assert {k: (v.n_hits, v.n_windows, v.reworded) for k, v in found.items()} == {(1, 1): (11, 11, False), (2, 2): (1, 1, False)}


def test_capitals_show_numbers_as_slots(spark):
    item = "we know that Alice buys 3 apples and 4 pears and 5 plums from Bob and 6 figs and 7 nuts from Carl"
    copy = item.upper()
    for n in "34567":
        copy = copy.replace(n, str(int(n) + 10))
    assert {k: v.reworded for k, v in run(spark, [(1, copy)], [(1, item)]).items()} == {(1, 1): True}


def test_names_that_begin_sentences_may_be_others(spark):
    item = "Alice has 3 apples in a basket. Bob gives her 5 more of them. Alice eats 2 and hands the rest to Carl."
    docs = [
        (1, "Zed has 4 apples in a basket. Mia gives her 6 more of them. Zed eats 1 and hands the rest to Tom."),
        (2, "Note that Zed has 4 apples in a basket. Mia gives her 6 more of them. Zed eats 1 and hands the rest to Tom."),
        (3, "Zed has 4 apples in a basket. Zed gives her 6 more of them. Zed eats 1 and hands the rest to Zed."),
    ]
    assert {k: v.reworded for k, v in run(spark, docs, [(1, item)]).items()} == {(1, 1): True, (2, 1): True}


def test_a_stem_of_all_items_makes_no_product(spark):
    rng = random.Random(11)
    stem = prose(rng, 14)
    items = [(i, stem + " " + prose(rng, rng.randint(16, 30))) for i in range(400)] + [(400, stem)]
    docs = [(d, prose(rng, 20) + " " + (items[d][1] if d % 10 == 0 else stem) + " " + prose(rng, 20)) for d in range(400)]
    found = run(spark, docs, items)
    # the stem alone is an item, which all documents hold; the others are held by those that quote them whole
    assert set(found) == {(d, 400) for d in range(400)} | {(d, d) for d in range(0, 400, 10)}
    windows = decontaminate.stage(
        spark.createDataFrame(items, "id long, text string").mapInArrow(decontaminate._windows([10], None, True), decontaminate._FIELDS), "test"
    )
    rare = decontaminate._rare(windows, 0.5)
    assert rare.groupBy("hash", "form").count().agg({"count": "max"}).first()[0] == 1


def test_the_share_of_windows_that_decides_is_exact(spark):
    rng = random.Random(12)
    stem, items, docs = prose(rng, 25), [], []
    for i in range(30):
        items.append((i, stem + " " + prose(rng, rng.randint(0, 40)) if i % 2 else prose(rng, rng.randint(0, 40)) + " " + stem))
    for d in range(60):
        words = items[d % 30][1].split()
        docs.append((d, " ".join(words[: rng.randint(8, len(words))]) + " " + prose(rng, 5)))
    windows = lambda text: [tuple(text.split()[k : k + 10]) for k in range(len(text.split()) - 9)]
    for share in (0.0, 0.3, 0.5, 0.9, 1.0):
        hits = {(d, i): sum(w in set(windows(text)) for w in windows(item)) for d, text in docs for i, item in items}
        want = {k for k, n in hits.items() if n and n / len(windows(items[k[1]][1])) >= share}
        assert set(run(spark, docs, items, share)) == want


def test_long_texts_and_the_length_of_the_shortest_item(spark):
    rng = random.Random(13)
    filler = prose(rng, 300) + " "
    docs = [(1, filler * 500 + ITEM + " " + filler * 500), (2, filler * 1000)]
    assert {k: v.reworded for k, v in run(spark, docs, [(1, ITEM)]).items()} == {(1, 1): False}
    df, short = spark.createDataFrame([(1, "so one two it is")], "doc_id long, text string"), spark.createDataFrame([(3, "one two")], "item_id long, text string")
    assert decontaminate.contaminations(df, short).count() == 0
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminations(df, short, least_words=2).collect()] == [(1, 3)]
