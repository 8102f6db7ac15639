"""Token counts by finite-state transducers compiled from a byte-level BPE file.

Two deterministic transducers whose transitions carry counts:

* The splitter reads character classes. It has 12 states and says where words begin (letters, digits or other characters
  with a space before them, white space, contractions). A group of texts is cut into chunks; in lockstep, every chunk is
  run from every state, which gives its state map; a parallel prefix scan composes the maps, which gives the state each
  chunk begins in; a second run from that state alone emits the word beginnings. No chunk waits for the one before it.
* The BPE transducer reads the bytes of a word. After a prefix, BPE has one last token; a longer prefix's last token is the
  only token that ends there and is stable next to the last token before it. So a state needs the last tokens at the places
  where a later token may still begin, and a transition emits by how much the number of tokens changes. States are
  determinised when a word first needs them; distinct words run in lockstep.

Special tokens in texts are matched first, as the library does by default, and count one each.

Null and empty texts have no bytes and no tokens. Repeated rows are counted row by row, null ids are values like any other,
empty tables give empty results, and no text is cut: a text of any length is one row's work in pieces of bounded size.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from audira.llm.shared import extended, map_batches, pick, text_groups, utf8
from audira.llm.words import hash_spans

# Character classes of the splitter: letters that may stand in a contraction are classes of their own.
CLASSES = ("letter", "stmd", "r", "v", "l", "e", "number", "other", "quote", "space", "white")
LETTER, STMD, R, V, L, E, NUMBER, OTHER, QUOTE, SPACE, WHITE = range(len(CLASSES))
LETTERS = (LETTER, STMD, R, V, L, E)
# States of the splitter: what the word that is open holds.
STATES = ("fresh", "letters", "digits", "others", "quote", "quote_r", "quote_v", "quote_l", "space", "white", "spaces", "whites")
FRESH, IN_LETTERS, IN_DIGITS, IN_OTHERS, AT_QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, ONE_SPACE, ONE_WHITE, SPACES, WHITES = range(len(STATES))
#: A transition says where words begin: at this character, at the one before it.
HERE, BEFORE = 1, 2
UNKNOWN = 255
CHUNK = 256


@cache
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output by (state, class); classes from len(CLASSES) on are the same at the begin of a text."""
    n = len(CLASSES)
    after, said = np.zeros((len(STATES), 2 * n), np.int64), np.zeros((len(STATES), 2 * n), np.uint8)

    def word(kind: int) -> int:
        return IN_LETTERS if kind in LETTERS else {NUMBER: IN_DIGITS, OTHER: IN_OTHERS, QUOTE: IN_OTHERS}[kind]

    def begin(kind: int) -> int:
        return {QUOTE: AT_QUOTE, SPACE: ONE_SPACE, WHITE: ONE_WHITE}.get(kind) or word(kind)

    for kind in range(n):
        blank = kind in (SPACE, WHITE)
        for state in range(len(STATES)):
            to, out = begin(kind), HERE
            if state in (IN_LETTERS, IN_DIGITS, IN_OTHERS) and not blank and word(kind) == state:
                to, out = state, 0
            elif state == AT_QUOTE and kind in (OTHER, QUOTE):
                to, out = IN_OTHERS, 0
            elif state == AT_QUOTE and kind in (STMD, R, V, L):
                to, out = {STMD: FRESH, R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}[kind], 0
            elif (state, kind) in ((QUOTE_R, E), (QUOTE_V, E), (QUOTE_L, L)):
                to, out = FRESH, 0
            elif state in (QUOTE_R, QUOTE_V, QUOTE_L):  # no contraction: the letter began a word
                to, out = (IN_LETTERS, BEFORE) if kind in LETTERS else (begin(kind), BEFORE | HERE)
            elif state in (ONE_SPACE, ONE_WHITE, SPACES, WHITES) and blank:
                to, out = (SPACES if kind == SPACE else WHITES), 0
            elif state == ONE_SPACE:  # the space belongs to the word
                to, out = word(kind), 0
            elif state == SPACES:  # only the last space does
                to, out = word(kind), BEFORE
            elif state == WHITES:
                to, out = begin(kind), BEFORE | HERE
            after[state, kind], said[state, kind] = to, out
            open_ = state in (QUOTE_R, QUOTE_V, QUOTE_L)
            after[state, n + kind], said[state, n + kind] = begin(kind), HERE | (BEFORE if open_ else 0)
    return after, said


def composed(maps: np.ndarray) -> np.ndarray:
    """Parallel prefix scan of state maps (chunks, states): row i becomes the map of chunks 0 to i."""
    step = 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].copy(), axis=1)
        step *= 2
    return maps


def word_starts(kinds: np.ndarray, at_start: np.ndarray) -> np.ndarray:
    """Where words begin, given each character's class and the places where texts begin."""
    n, width = len(kinds), 2 * len(CLASSES)
    symbols = kinds.astype(np.int64)
    symbols[at_start] += len(CLASSES)
    n_chunks = -(-(n + 1) // CHUNK)
    padded = np.full(n_chunks * CHUNK, len(CLASSES), np.int64)  # behind the end another text begins
    padded[:n] = symbols
    columns = np.ascontiguousarray(padded.reshape(n_chunks, CHUNK).T)
    after, said = (x.reshape(-1) for x in splitter())
    maps = np.tile(np.arange(len(STATES)), (n_chunks, 1))
    for row in columns:
        maps = after[maps * width + row[:, None]]
    state = np.concatenate([[FRESH], composed(maps)[:-1, FRESH]])
    out = np.zeros((CHUNK, n_chunks), np.uint8)
    for i, row in enumerate(columns):
        at = state * width + row
        out[i], state = said[at], after[at]
    marks = out.T.reshape(-1)
    begins = (marks & HERE) > 0
    begins[:-1] |= (marks[1:] & BEFORE) > 0
    return np.flatnonzero(begins[:n])


@cache
def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level files: itself if it is visible, else the next one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


#: Rank of the merge that uses up a whole token: none does.
NEVER = 1 << 60


class BpeTransducer:
    """Lazily determinised: state 0 is the begin of a word, ``next`` and ``emits`` are tables by (state, byte)."""

    def __init__(self, path: str, max_states: int = 60_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError(f"{path} is no plain byte-level BPE file")
        letters = byte_letters()
        tokens = {t: i for t, i in model["vocab"].items()}
        self.id_of = {bytes(letters[c] for c in t): i for t, i in tokens.items() if all(c in letters for c in t)}
        self.prefixes = {t[:k] for t in self.id_of for k in range(len(t))}  # ends that a longer token may begin with
        self.rank, self.parts, self.made, self.right_of, self.used_in = {}, {}, {}, {}, {}
        self.text = {i: t for t, i in self.id_of.items()}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            new = tokens[a + b]
            self.rank[tokens[a], tokens[b]] = r
            self.right_of.setdefault(tokens[a], []).append(tokens[b])
            self.used_in.setdefault(tokens[a], []).append((bytes(letters[c] for c in a + b), r))
            self.parts.setdefault(new, (tokens[a], tokens[b]))
            self.made.setdefault(new, r)
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.max_states = max_states
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        self.clear()

    def clear(self) -> None:
        self.edges: dict[int, tuple] = {}
        self.left: dict[int, dict] = {}
        self.narrowed: dict[tuple[tuple, bytes], tuple] = {}
        self.next, self.emits = np.full((1024, 256), -1, np.int32), np.zeros((1024, 256), np.int8)
        # A state: the longest end of the prefix that may begin a token, and for every place from there on at which one may
        # begin: what merges threaten the last token before it, and the tokens up to it less the tokens up to now.
        self.states: list[tuple[bytes, tuple]] = [(b"", (((), 0),))]
        self.number = {self.states[0]: 0}
        self.slot_hash, self.slot_count = np.zeros(1 << 19, np.uint64), np.full(1 << 19, -1, np.int64)

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces at one edge of a token while BPE makes it, each with the merge that uses it up."""
        out, used = [], NEVER
        while True:
            out.append((token, used))
            if token not in self.parts:
                return out
            used, token = self.made[token], self.parts[token][side]

    def edge(self, token: int) -> tuple:
        """The right spine of a token, without pieces that no merge has on its left."""
        known = self.edges.get(token)
        if known is None:
            known = self.edges[token] = tuple((x, used) for x, used in self.spine(token, 1) if x in self.right_of)
        return known

    def threats(self, edge: tuple, ahead: bytes) -> tuple:
        """The merges (piece of the next token, rank) that an edge would lose to, when the text ahead is known so far."""
        known = self.narrowed.get((edge, ahead))
        if known is None:
            found = [(y, self.rank[x, y]) for x, used in edge for y in self.right_of[x] if self.rank[x, y] < used]
            known = self.narrowed[edge, ahead] = self.still(found, ahead)
        return known

    def still(self, found: list | tuple, ahead: bytes) -> tuple:
        """Threats that remain. A rank is replaced by the smallest one that has the same effect, so that states meet.

        The piece y joins the token before it if that merge's rank is at most the rank of the merge that uses y up inside
        the next token; which merges those can be follows from the text ahead. If y itself may be the next token, a merge
        of any rank takes it.
        """
        worst: dict[int, int] = {}
        for y, r in found:
            text = self.text[y]
            if not (text.startswith(ahead) or ahead.startswith(text)):
                continue
            uses = [u for whole, u in self.used_in.get(y, ()) if u >= r and (whole.startswith(ahead) or ahead.startswith(whole))]
            level = min(uses, default=NEVER if len(text) > len(ahead) else None)
            if level is not None:
                worst[y] = min(worst.get(y, NEVER), level)
        return tuple(sorted(worst.items()))

    def is_stable(self, threats: tuple, token: int) -> bool:
        """Whether BPE leaves a token after what the threats stand for as it is.

        Two tokens join if a merge takes two of their edge pieces before those are used up. Equal merges are done from the
        left: the left token's own one goes first, the right token's own one last.
        """
        if not threats:
            return True
        used = self.left.get(token)
        if used is None:
            used = self.left[token] = dict(self.spine(token, 0))
        return not any(y in used and r <= used[y] for y, r in threats)

    def compile(self, state: int, byte: int) -> None:
        end, places = self.states[state]
        text = end + bytes([byte])
        for k in range(len(text)):
            token = self.id_of.get(text[k:])
            if token is None or places[k] is None:
                continue
            # The last place holds an edge, as no text ahead of it was known before.
            threats = self.threats(places[k][0], text[k:]) if k == len(end) else self.still(places[k][0], text[k:])
            if self.is_stable(threats, token):
                break
        else:
            raise ValueError("a byte is missing in the vocabulary")
        change = places[k][1] + 1  # places hold counts relative to the prefix read so far
        keep = next(i for i in range(len(text) + 1) if text[i:] in self.prefixes)
        moved = [None] * (len(text) - keep)
        for i in range(keep, len(text)):
            if text[i:] in self.prefixes:
                threats = (self.threats if i == len(end) else self.still)(places[i][0], text[i:])
                moved[i - keep] = (threats, places[i][1] - change)
        key = (text[keep:], (*moved, (self.edge(token), 0)))
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
            if to >= len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.emits = np.concatenate([self.emits, np.zeros_like(self.emits)])
        self.next[state, byte], self.emits[state, byte] = to, change

    def run(self, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Tokens of the words [first, last), all in lockstep."""
        order = np.argsort(first - last, kind="stable")  # longest first
        at, size = first[order], (last - first)[order]
        state, count = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        n = len(at)
        for step in range(int(size.max(initial=0))):
            n = int(np.searchsorted(-size[:n], -step, "left"))
            byte = data[at[:n] + step].astype(np.int64)
            to = self.next[state[:n], byte]
            if (to < 0).any():
                missing = np.unique(state[:n][to < 0] * 256 + byte[to < 0])
                for m in missing.tolist():
                    self.compile(m >> 8, m & 255)
                to = self.next[state[:n], byte]
            count[:n] += self.emits[state[:n], byte]
            state[:n] = to
        out = np.empty(len(at), np.int64)
        out[order] = count
        return out

    def counts_of_words(self, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        hashes = hash_spans(data, first, last)
        slot = (hashes >> np.uint64(45)).astype(np.int64)
        count = np.where(self.slot_hash[slot] == hashes, self.slot_count[slot], -1)
        missed = np.flatnonzero(count < 0)
        if len(missed):
            if len(self.states) > self.max_states:
                self.clear()
            _, example, which = np.unique(hashes[missed], return_index=True, return_inverse=True)
            at = missed[example]
            count[missed] = self.run(data, first[at], last[at])[which]
            self.slot_hash[slot[missed]], self.slot_count[slot[missed]] = hashes[missed], count[missed]
        return count

    def learn_kinds(self, codes: np.ndarray) -> None:
        """Ask the library's own splitter for the class of characters that are new."""
        from tokenizers.pre_tokenizers import ByteLevel

        split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        for c in np.unique(codes).tolist():
            near = [len(split(x + chr(c))) == 1 for x in "A1!"]
            kind = (LETTER, NUMBER, OTHER)[near.index(True)] if any(near) else WHITE
            self.kinds[c] = {" ": SPACE, "'": QUOTE, "r": R, "v": V, "l": L, "e": E}.get(chr(c), STMD if chr(c) in "stmd" else kind)

    def count(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Tokens of each text of a group; bytes that are no UTF-8 count as replacement characters."""
        data, bounds = utf8(data, bounds)
        n_rows = len(bounds) - 1
        total = np.zeros(n_rows, np.int64)
        if not len(data):
            return total
        cuts, special = self.special_spans(data, bounds)
        np.add.at(total, np.searchsorted(bounds, special, "right") - 1, 1)
        codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        kinds = self.kinds[codes]
        if (kinds == UNKNOWN).any():
            self.learn_kinds(codes[kinds == UNKNOWN])
            kinds = self.kinds[codes]
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        begins = np.unique(np.concatenate([bounds[:-1], cuts]))
        begins = begins[begins < len(data)]
        first = lead[word_starts(kinds, np.searchsorted(lead, begins))]
        last = np.append(first[1:], len(data))
        counts = self.counts_of_words(data, first, last)
        if len(special):  # the pieces between a special token's begin and end don't count
            counts[np.isin(np.searchsorted(begins, first, "right") - 1, np.searchsorted(begins, special))] = 0
        so_far = np.concatenate([[0], np.cumsum(counts)])
        at = so_far[np.searchsorted(first, bounds)]
        return total + np.diff(at)

    def special_spans(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends of special tokens as cuts, and their begins."""
        raw = data.tobytes()
        if not any(s.encode() in raw for s in self.special):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pattern = re.compile(b"|".join(re.escape(s.encode()) for s in self.special))
        found = [(m.start(), m.end()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True) for m in pattern.finditer(raw, a, b)]
        spans = np.array(found, np.int64).reshape(-1, 2)
        return spans.reshape(-1), spans[:, 0]


@cache
def transducer(path: str) -> BpeTransducer:
    return BpeTransducer(path)


def token_counts(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens). No shuffle."""
    rows = pick(docs, doc_id, text).toDF("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, bounds in text_groups(batch.column(1)):
                counts = transducer(tokenizer).count(data, bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(np.diff(bounds)), pa.array(counts)], names=["doc_id", "n_bytes", "n_tokens"])

    schema = extended(rows.select("doc_id"), n_bytes=T.LongType(), n_tokens=T.LongType())
    return map_batches(rows, run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
