import random
import zlib

import brute
import numpy as np
from pyspark.sql import functions as F

from audira.llm import decontaminate, language


def test_languages_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language.language_report(docs).join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    test = [r for r in got if r.held_out and r.n > 60]
    assert sum(r.lang == r.lang_pred for r in test) >= 0.98 * len(test) > 20


def test_predictions_read_the_text_only(docs_of, clashing):
    rows = [(i, "the cat and the dog", "en", "s") for i in range(20)] + [(100 + i, "der hund und die katze", "de", "s") for i in range(20)]
    rows += [(200, None, "en", None), (201, "", None, None), (202, "12 !? 34", "de", "s"), (203, "the dog", "de", "x"), (204, "und die", None, None)]
    rows += [(None, "the cat", None, None), (205, "ÇÉ" * 500_000 + " the", None, None)]
    got = {r.doc_id: r for r in language.language_report(clashing(docs_of(rows))).collect()}
    assert len(got) == len(rows)
    assert {i: got[i].lang_pred for i in (0, 100, 200, 201, 202, 203, 204, None)} == {0: "en", 100: "de", 200: "und", 201: "und", 202: "und", 203: "en", 204: "de", None: "en"}
    assert all(0 <= r.score <= 1 for r in got.values()) and got[200].score == 0 and got[0].score > 0.5


def test_nothing_to_learn_from(docs_of):
    assert [r.lang_pred for r in language.language_report(docs_of([(1, "text", None, None)])).collect()] == ["und"]
    assert language.language_report(docs_of([])).collect() == []


def test_binding_depends_on_the_order():
    p = language.Profile()
    code = lambda w: sum((ord(c) - 96) << 6 * (2 - i) for i, c in enumerate(w))
    v = language.trigram_vectors(np.array([code("abc"), code("cba"), code("abc")]), p).astype(int)
    assert (v[0] @ v[2]) == p.dimensions and abs(v[0] @ v[1]) < p.dimensions / 5


def edited(words, n, pick):
    words = list(words)
    for _ in range(n):
        at = pick.randrange(len(words))
        kind = pick.randrange(3)
        if kind == 0:
            words[at] = f"new{pick.randrange(10**6)}"
        elif kind == 1:
            words.insert(at, f"new{pick.randrange(10**6)}")
        elif len(words) > 1:
            words.pop(at)
    return words


def leak_case(seed, n_items=30, n_docs=60):
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    items = [(k, " ".join(pick.choice(words) for _ in range(pick.randrange(8, 60)))) for k in range(n_items)]
    docs = []
    for i in range(n_docs):
        body = [pick.choice(words) for _ in range(pick.randrange(0, 80))]
        for _ in range(pick.randrange(0, 3)):
            item = pick.choice(items)[1].split()
            part = edited(item, pick.randrange(0, int(0.26 * len(item)) + 1), pick)
            at = pick.randrange(len(body) + 1)
            body[at:at] = part
        docs.append((i, " ".join(w.upper() if pick.random() < 0.2 else w + pick.choice(["", ",", ".\n"]) for w in body)))
    return docs, items


def test_leaks_match_plain_code(spark, docs_of, clashing):
    docs, items = leak_case(1)
    items += [(100, None), (101, "..."), (102, "tiny item here"), (103, items[0][1]), (None, items[1][1])]
    docs += [(200, None), (201, ""), (202, "Tiny, ITEM here!"), (203, "a tiny item here"), (204, items[0][1]), (204, items[0][1]), (None, items[2][1])]
    bench = clashing(spark.createDataFrame(items, "item_id long, text string"))
    table = clashing(docs_of([(i, t, None, None) for i, t in docs]))
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.leaks(table, bench).collect()}
    want = brute.leaks(docs, items)
    assert set(got) <= set(want) and all(want[k] == got[k] for k in got)
    lost = set(want) - set(got)
    assert len(lost) <= 0.02 * len(want) and all(want[k] > 0 for k in lost) and len(want) > 40
    clean = decontaminate.without_leaks(table, bench)
    assert clean.columns == table.columns
    assert {r[0] for r in clean.select("doc_id").collect()} == {i for i, _ in docs} - {i for i, _ in got}


def test_recall_at_the_largest_number_of_edits():
    config, pick = decontaminate.Leaks(), random.Random(2)
    for size in (10, 20, 33, 59, 200):
        found = 0
        for _ in range(200):
            item = [f"w{pick.randrange(500)}" for _ in range(size)]
            window = (edited(item, config.edits(size), pick) + [f"z{i}" for i in range(size)])[:size]
            a, b = (np.array([[zlib.crc32(w.encode()) * 2654435761 + 1 for w in x]], np.uint64) for x in (item, window))
            found += (decontaminate.embedded(a, config) == decontaminate.embedded(b, config)).any()
        assert found >= 198, size


def test_recall_of_items_back_to_back(spark, docs_of):
    """Edited items end to end with exact ones of a large benchmark: each word on from the begin of an edited item there are
    fewer strange pairs, down to none in the exact item behind it."""
    config, pick = decontaminate.Leaks(), random.Random(4)
    words = [f"w{i}" for i in range(300)]
    items = [(k, [pick.choice(words) for _ in range(37)]) for k in range(600)]
    docs, want = [], {"exact": set(), "spread": set(), "anywhere": set()}
    for i in range(60):
        text, n = [], config.edits(37)
        for at, (k, item) in enumerate(pick.sample(items, 4)):
            kind = "exact" if at % 2 else ("spread", "anywhere")[i % 2]
            want[kind].add((i, k))
            if kind == "spread":
                item = [f"new{pick.randrange(10**6)}" if j % 5 == 2 and j // 5 < n else w for j, w in enumerate(item)]
            text += edited(item, n, pick) if kind == "anywhere" else item
        docs.append((i, " ".join(text), None, None))
    bench = spark.createDataFrame([(k, " ".join(item)) for k, item in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs_of(docs), bench, config=config).collect()}
    lost = {kind: f"{len(x - got)}/{len(x)}" for kind, x in want.items() if len(x - got) > 0.02 * len(x)}
    assert lost == {}


def test_words_left_out_at_the_end_of_a_text(spark, docs_of):
    """Nothing follows the passage, so each word left out also makes its window shorter."""
    config, pick = decontaminate.Leaks(), random.Random(5)
    items = [(k, [f"w{pick.randrange(400)}" for _ in range(37)]) for k in range(100)]
    docs = []
    for k, item in items:
        out = set(pick.sample(range(1, 36, 2), config.edits(37)))  # one by one, so that each makes a strange pair
        docs.append((k, " ".join([f"z{i}" for i in range(20)] + [w for j, w in enumerate(item) if j not in out]), None, None))
    bench = spark.createDataFrame([(k, " ".join(item)) for k, item in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs_of(docs), bench, config=config).collect()}
    lost = {k for k, _ in items} - {i for i, k in got if i == k}
    assert len(lost) <= 2


def test_long_documents_and_items(spark, docs_of):
    pick = random.Random(3)
    words = [str(pick.randrange(10**6)) for _ in range(200_000)]
    items = spark.createDataFrame([(1, " ".join(words[150_000:150_900])), (2, " ".join(words[-30:]))], "item_id long, text string")
    got = decontaminate.leaks(docs_of([(7, " ".join(words), None, None)]), items).collect()
    assert {(r.item_id, r.edits, r.n_words) for r in got} == {(1, 0, 900), (2, 0, 30)}


def test_empty_tables(spark, docs_of):
    none, some = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, "a b c d e f g h i")], "item_id long, text string")
    docs = docs_of([(1, "a b c d e f g h i", None, None)])
    assert decontaminate.leaks(docs, none).collect() == [] and decontaminate.leaks(docs_of([]), some).collect() == []
    assert len(decontaminate.without_leaks(docs, none).collect()) == 1
