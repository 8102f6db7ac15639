import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from audira.llm import huffman, token_files
from audira.llm.fst_tokens import splitter, token_counts, transducer, word_starts

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PARTS = list("aBc'stmdrevl l' 12é߀ !?$.,\n\t\r") + ["'re", "'s", "<|endoftext|>", "<|", "日本", "İ", "Σ", "é", "\x00", " ", "''", "ſ", "ŉ", "½", "ª", "  ", "\n\n", "'ll", "😀", "the", " of"]


def texts(n, seed):
    pick = random.Random(seed)
    fixed = [None, "", " ", "\n \n", "a" * 3000, "ab" * 20000, "'" * 50, "<|endoftext|>" * 5, "word " * 30000, "x<|endof" + "text|>y", "'re've'll's", "日" * 2000]
    return fixed + ["".join(pick.choice(PARTS) for _ in range(pick.randrange(40))) for _ in range(n)]


def test_counts_equal_the_library(docs_of, clashing):
    found = texts(1500, 1)
    docs = clashing(docs_of([(i, t, None, None) for i, t in enumerate(found)]))
    library = Tokenizer.from_file(BYTE_BPE)
    want = [len(e.ids) for e in library.encode_batch([t or "" for t in found], add_special_tokens=False)]
    got = {r.doc_id: r for r in token_counts(docs, BYTE_BPE).collect()}
    assert [got[i].n_tokens for i in range(len(found))] == want
    assert all(got[i].n_bytes == len((t or "").encode()) and got[i].over_limit == (want[i] > 512) for i, t in enumerate(found))


def test_counts_of_no_rows_and_null_ids(docs_of):
    assert token_counts(docs_of([]), BYTE_BPE).collect() == []
    assert [tuple(r) for r in token_counts(docs_of([(None, "a", None, None)] * 2), BYTE_BPE).collect()] == [(None, 1, 1, False)] * 2


def test_chunk_maps_agree_with_one_run():
    """Composed state maps of chunks say the same as the splitter run from end to end."""
    after, said = splitter()
    random_ = np.random.default_rng(2)
    kinds = random_.integers(0, 11, 5000).astype(np.uint8)
    at = np.unique(random_.integers(0, 5000, 40))
    at[0] = 0
    state, marks = 0, np.zeros(5001, bool)
    symbols = kinds.astype(int)
    symbols[at] += 11
    for i, s in enumerate([*symbols, 11]):
        out = said[state, s]
        marks[i] |= bool(out & 1)
        if out & 2:
            marks[i - 1] = True
        state = after[state, s]
    assert word_starts(kinds, at).tolist() == np.flatnonzero(marks[:5000]).tolist()


def test_states_stay_bounded():
    t = transducer(BYTE_BPE)
    t.clear()
    t.max_states = 50
    data = np.frombuffer(" ".join(str(i * 7919) for i in range(3000)).encode(), np.uint8)
    want = len(Tokenizer.from_file(BYTE_BPE).encode(data.tobytes().decode()).ids)
    for _ in range(2):
        assert t.count(data, np.array([0, len(data)])).tolist() == [want]
    t.max_states = 60_000


def expected_files(rows):
    library = Tokenizer.from_file(WORD_BPE)
    out, start = [], 0
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_files_give_back_every_id(spark, docs_of, clashing, tmp_path):
    rows = sorted((i * 3 - 100, t) for i, t in enumerate(texts(400, 2)))
    docs = clashing(docs_of([(i, t, None, None) for i, t in rows], partitions=5))
    got = sorted(tuple(r) for r in token_files.token_file_report(docs, WORD_BPE).collect())
    assert got == expected_files(rows)
    path, fmt = str(tmp_path / "ids"), token_files.TokenFormat(block_ids=500, checkpoint_ids=7)
    token_files.write_token_files(docs, path, WORD_BPE, fmt=fmt)
    back = sorted((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in token_files.read_token_files(spark, path, fmt).collect())
    assert back == got
    stored = spark.read.parquet(f"{path}/blocks").collect()
    assert len(stored) > 20 and all(sum(b.doc_lengths) <= 500 or len(b.doc_ids) == 1 for b in stored)


def test_files_of_ties_nulls_and_nothing(docs_of):
    rows = [(None, "b"), (None, "b"), (4, "x y"), (4, "x y"), (4, None)]
    got = token_files.token_file_report(docs_of([(i, t, None, None) for i, t in rows]), WORD_BPE).collect()
    assert sum(r.n_tokens for r in got) == 2 + 2 + 3 + 3 + 1
    assert sorted(r.start for r in got if r.doc_id is None) == [0, 2]
    ends = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert token_files.token_file_report(docs_of([]), WORD_BPE).collect() == []


@pytest.mark.parametrize(("n", "limit"), [(1, 16), (2, 16), (3, 2), (300, 9), (300, 30), (40000, 16)])
def test_huffman_codes(n, limit):
    random_ = np.random.default_rng(n)
    counts = np.minimum(random_.zipf(1.2, n), 10**9).astype(np.int64)
    lengths = huffman.code_lengths(counts, limit)
    assert lengths.max() <= limit and (n == 1 or (0.5**lengths).sum() == 1)
    if limit == 30 and n > 1:  # long enough not to limit: as good as a plain Huffman code
        import heapq

        heap, cost = counts.tolist(), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            pair = heapq.heappop(heap) + heapq.heappop(heap)
            cost += pair
            heapq.heappush(heap, pair)
        assert (lengths * counts).sum() == cost
    ids = random_.permutation(10 * n)[:n]
    book = huffman.Codebook.from_counts(ids, counts, min(limit, huffman.MAX_BITS))
    text = random_.choice(ids, 5000)
    bits, offsets = huffman.pack(text, *book.encoder())
    places = offsets[::100]
    back = huffman.unpack(bits, places, np.full(len(places), 100), *book.decoder(), book.width)
    assert np.concatenate(back).tolist() == text.tolist()


def test_bytes_that_are_no_utf8(spark):
    """They count as replacement characters, in every row for itself, as in the token files."""
    rows = spark.sql("SELECT * FROM VALUES (1L, X'61FF62'), (2L, X'C3'), (3L, X'A96162'), (4L, X'6120C3A9') AS t(doc_id, raw)").selectExpr("doc_id", "cast(raw AS string) AS text")
    library = Tokenizer.from_file(BYTE_BPE)
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts(rows.coalesce(1), BYTE_BPE).collect()}
    raw = {1: b"a\xffb", 2: b"\xc3", 3: b"\xa9ab", 4: b"a \xc3\xa9"}
    assert got == {i: (len(x), len(library.encode(x.decode("utf-8", "replace"), add_special_tokens=False).ids)) for i, x in raw.items()}
