"""Plain versions of the operators, one row at a time."""

from __future__ import annotations

import collections
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {g for g, n in collections.Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in often for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_lines": len(lines),
    }


def shingles(text):
    words = WORD.findall(lower(text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def components(sets, min_pct=75):
    """{id: smallest reachable id} for {id: set}."""
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, n in collections.Counter(j for g in s for j in holders[g] if j < i).items():
            if 100 * n >= min_pct * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


LETTERS = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")


def passage_edits(item, text):
    """Word edits between an item and the best passage of a text."""
    before = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        now = [i] + [0] * len(text)
        for j, x in enumerate(text, 1):
            now[j] = min(before[j - 1] + (w != x), before[j] + 1, now[j - 1] + 1)
        before = now
    return min(before)


def leaks(docs, items, max_edits=0.2, min_words=8):
    out = {}
    for i, text in docs:
        words = LETTERS.findall((text or "").lower())
        for k, item in items:
            want = LETTERS.findall((item or "").lower())
            if not want:
                continue
            if len(want) < min_words:
                if words == want:
                    out[i, k] = 0
            elif (e := passage_edits(want, words)) <= int(max_edits * len(want)):
                out[i, k] = e
    return out


def mix_targets(sizes, max_copies=3):
    """{source: target} for {source: size}; null sources last."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= max_copies * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = float(max_copies * sizes[s])
            left -= target[s]
        open_ -= full
    return target
