import collections
import random
import re
import zlib

import numpy as np

from audira.llm import spelling
from audira.llm.spelling import VariantPlan

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def plain_vocabulary(rows, plan=VariantPlan()):
    n = collections.Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % plan.typo_every == 0:
                cut = h % len(word)
                word = word[:cut] + word[cut + 1 :]
            n[word] += 1
    return {w: c for w, c in n.items() if len(w) >= plan.min_chars and c >= plan.min_count}


def plain_near(words):
    """Words by what is left of them without one code point: near words share such a form."""
    shorter = collections.defaultdict(set)
    for w in words:
        shorter[w].add((w, None))
        for i in range(len(w)):
            shorter[w[:i] + w[i + 1 :]].add((w, i))
    out = collections.defaultdict(set)
    for group in shorter.values():
        for a, i in group:
            for b, j in group:
                if a != b and (i is None or j is None or (i == j and len(a) == len(b))):
                    out[a].add(b)
    return out


def plain_variants(rows, plan=VariantPlan()):
    n = plain_vocabulary(rows, plan)
    near, form = plain_near(n), {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


def test_documents_against_plain_code(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = plain_variants([(r.doc_id, r.text) for r in docs.collect()])
    assert got(spelling.spelling_variants(docs)) == want
    assert sum(w[3] is not None for w in want) > 20


def test_edge_cases(docs_of, clashing):
    rows = [(i, "Lettre lettré LETTRE; lettr lettres lettrés lettress x×y÷zz", "fr", "s") for i in range(6)]
    rows += [(None, "lettre " * 9, None, None), (None, "lettre " * 9, None, None), (7, None, None, None), (8, "", None, None), (9, "12 Ābcdefg", None, None)]
    rows += [(10, "y" * 1500 + " " + "y" * 1499 + "z " + "y" * 1499 + " 12 " * 100_000, None, None)] * 3 + [(11, "anná 中anna, annas", None, None)] * 4
    assert got(spelling.spelling_variants(clashing(docs_of(rows)))) == plain_variants([r[:2] for r in rows])
    assert got(spelling.spelling_variants(docs_of([]))) == []
    assert got(spelling.spelling_variants(docs_of([(1, None, None, None)]))) == []


def test_groups_are_split_without_losing_a_pair(spark):
    """Groups of at most three words: shared beginnings and ends are split again and again."""
    pick = random.Random(3)
    words = {"".join(pick.choice("ab") for _ in range(pick.randrange(5, 10))) for _ in range(300)} | {"prefix" + a + b + "suffix" for a in "abcdef" for b in ["", *"abcdef"]}
    plan = VariantPlan(max_group=3)
    pairs = spelling.near_pairs(spark.createDataFrame([(w, 5) for w in words], "word string, n long"), plan)
    want = plain_near(words)
    assert sorted((r.word, r.near) for r in pairs.collect()) == sorted((a, b) for a in want for b in want[a])


def test_chains_of_forms(spark):
    rows = [("a" * (5 + i), 2**i, "a" * (6 + i) if i < 20 else None) for i in range(21)]
    forms = spark.createDataFrame(rows, "word string, n long, form string")
    assert {r.root for r in spelling.with_roots(forms).collect()} == {"a" * 25}


def test_checksums_go_on_from_the_id():
    words = [b"", b"a", b"caf\xc3\xa9", b"x" * 64, b"y" * 200]
    data = np.frombuffer(b"".join(words), np.uint8)
    last = np.cumsum([len(w) for w in words])
    first = last - [len(w) for w in words]
    begun = np.array([zlib.crc32(b"%d:" % i) for i in range(5)], np.uint32)
    assert spelling.checksums(data, first, last, begun).tolist() == [zlib.crc32(b"%d:%s" % (i, w)) for i, w in enumerate(words)]


def test_scan_of_random_lists():
    pick = random.Random(5)
    for _ in range(150):
        groups = [sorted({"".join(pick.choice("abc") for _ in range(pick.randrange(0, 7))) for _ in range(pick.randrange(1, 30))}) for _ in range(3)]
        words = [w for g in groups for w in g]
        size = np.array([len(w) for w in words])
        codes = np.frombuffer("".join(words).encode("utf-32-le") + bytes(4), np.uint32)
        asked, found = spelling.near_in_groups(codes, np.cumsum(size) - size, size, np.repeat(range(3), [len(g) for g in groups]))
        at = np.cumsum([0, *map(len, groups)])
        want = [(at[k] + g.index(a), at[k] + g.index(b)) for k, g in enumerate(groups) for a, others in plain_near(g).items() for b in others]
        assert sorted(zip(asked.tolist(), found.tolist(), strict=True)) == sorted(want)
