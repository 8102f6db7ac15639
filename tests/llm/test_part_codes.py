import hashlib
import math

import numpy as np
import pytest

from audira.llm import part_codes as pc

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=16, entries=64, rounds=2):
    """The contract, number by number."""
    kept = sorted(((i, [math.floor(256 * x) for x in v], k) for i, v, k in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: r[:2])
    if not kept:
        return [], None
    w = len(kept[0][1]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = [best(c[p], books[p])[1] for c in cut]
            books[p] = [[sum(col) // len(col) for col in zip(*[c[p] for c, k in zip(cut, mine, strict=True) if k == e], strict=True)] or old for e, old in enumerate(books[p])]
    found = [[best(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    total = {}
    for (_, _, k), e in zip(kept, errors, strict=True):
        total[k] = total.get(k, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, "".join(f"{e:02x}" for _, e in f), err, total[k], digest) for (i, _, k), f, err in zip(kept, found, errors, strict=True)), books


def rows_of(df):
    return sorted(tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def test_against_plain_code(spark, clashing):
    random = np.random.default_rng(4)
    rows = [(int(i), [float(np.float32(x)) for x in random.normal(size=32).round(1)], None if i % 7 == 0 else int(i % 3)) for i in random.permutation(300)]
    rows += [(1000 + i, rows[i][1], 1) for i in range(20)]  # equal vectors
    rows += [(2000, None, 1), (2001, [None] + [0.5] * 31, 1), (2002, [float("nan")] * 32, 2), (2003, [float("inf")] * 32, 2), (2004, [-1000.0] * 32, 2)]
    df = clashing(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert rows_of(pc.part_codes(df)) == plain(rows)[0]


def test_few_empty_and_odd_vectors(spark):
    few = [(3, [0.25] * 16, None), (1, [-0.1] * 16, None), (1, [-0.1] * 16, 4)]
    assert rows_of(pc.part_codes(spark.createDataFrame(few, SCHEMA))) == plain(few)[0]
    odd = [(7, [], 1), (8, [1.0] * 17, 1), (9, [1.0] * 32, 1)]
    assert rows_of(pc.part_codes(spark.createDataFrame(few + odd, SCHEMA))) == plain(few)[0]
    none = pc.part_codes(spark.createDataFrame([(1, None, 2), (2, [], 2)], SCHEMA))
    assert none.collect() == [] and pc.part_codes(spark.createDataFrame([], SCHEMA)).columns == none.columns
    with pytest.raises(Exception, match="component of size"):
        pc.part_codes(spark.createDataFrame([(1, [1e30] * 16, 1)], SCHEMA))


def test_orchard_finds_the_nearest_and_lowest():
    random = np.random.default_rng(8)
    for k, width, spread in [(1, 2, 5), (7, 1, 3), (64, 3, 4), (256, 4, 50)]:
        book = random.integers(-spread, spread + 1, (k, width))  # with equal entries
        parts = random.integers(-2 * spread, 2 * spread + 1, (500, width))
        d = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
        code, best = pc.orchard(parts, pc.Neighbours.of(book))
        assert (code == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_orchard_looks_at_few_entries(monkeypatch):
    """The lists end beyond twice the distance: far fewer distances than all of them."""
    random = np.random.default_rng(9)
    book = random.integers(-5000, 5000, (64, 2))
    parts = book[random.integers(0, 64, 400)] + random.integers(-20, 20, (400, 2))
    near, looked = pc.Neighbours.of(book), []

    class Counting(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, np.ndarray):
                looked.append(len(at))
            return super().__getitem__(at).view(np.ndarray)

    counted = pc.Neighbours(near.entries.view(Counting), near.order, near.distance)
    pc.orchard(parts, counted)
    assert sum(looked) < 0.5 * 64 * len(parts)
