"""Plain, slow versions of the operators, to hold their results against."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text: str | None) -> str:
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def near_classes(rows: list[tuple[int, str | None]], k: int, num: int, den: int) -> set[tuple[int, int, int]]:
    """(doc_id, set size, least linked document) by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = WORD.findall(lowered(text))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    holders: dict = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        overlap: dict[int, int] = {}
        for g in s:
            for j in holders[g]:
                if j < i:
                    overlap[j] = overlap.get(j, 0) + 1
        for j, n in overlap.items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(rows):
        r = root(i)
        least[r] = min(least.get(r, doc), doc)
    return {(doc, len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(rows)}


def without_repeats(rows: list[tuple[int, str | None]], window: int) -> list[tuple[int, int, int, str]]:
    """(doc_id, words, words removed, kept text): words covered by a window that starts twice or more go."""
    split = [WORD.findall(text or "") for _, text in rows]
    seen: dict[tuple, int] = {}
    for w in split:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for (doc, _), w in zip(rows, split, strict=True):
        covered = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                covered.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in covered]
        out.append((doc, len(w), len(covered), " ".join(kept)))
    return sorted(out)


def leaks(text: str | None, items: list[str | None], span: int, tolerated: int) -> bool:
    """Whether a window of an item stands in the text with few words substituted; short items stand whole."""
    words = WORD.findall((text or "").lower())
    for item in items:
        own = WORD.findall((item or "").lower())
        n, most = (span, tolerated) if len(own) >= span else (len(own), 0)
        for q in range(len(own) - n + 1 if own else 0):
            for p in range(len(words) - n + 1):
                wrong = 0
                for i in range(n):
                    wrong += own[q + i] != words[p + i]
                    if wrong > most:
                        break
                else:
                    return True
    return False


@dataclass
class Context:
    counts: Counter
    size: int
    prior: float = 0.0

    @property
    def once(self) -> int:
        return sum(n == 1 for n in self.counts.values())


END = None


def behind(tree: dict[tuple, Context], history: tuple, token: str | None) -> float:
    """Probability of a token in the longest context of the tree that the history ends with."""
    own = tree[()]
    p = (own.counts[token] + 0.5) / (own.size + 0.5 * (len(own.counts) + 1))
    for depth in range(1, len(history) + 1):
        own = tree.get(history[len(history) - depth :])
        if own is None:
            break
        n = own.counts[token]
        p = ((n if n >= 2 else 0) + (own.once + own.prior) * p) / (own.size + own.prior)
    return p


def suffix_tree(rows: list[tuple[int | None, str | None]], bits: float, prior: float) -> tuple[dict[tuple, Context], list[tuple[int, float]]]:
    """The tree, and number of tokens and log10 probability of each row."""
    texts = [[END, *WORD.findall(lowered(x)), END] for _, x in rows]
    taught = [t for (d, _), t in zip(rows, texts, strict=True) if d is not None and zlib.crc32(str(d).encode()) % 5 != 1]
    counts = Counter(w for t in taught for w in t[1:])
    tree = {(): Context(counts, sum(counts.values()), prior)}
    last, depth = set(tree), 0
    while last:
        depth += 1
        seen: dict[tuple, Counter] = defaultdict(Counter)
        for t in taught:
            for i in range(depth, len(t)):
                if tuple(t[i - depth + 1 : i]) in last:
                    seen[tuple(t[i - depth : i])][t[i]] += 1
        last = set()
        for context, counts in seen.items():
            size, once = sum(counts.values()), sum(n == 1 for n in counts.values())
            saved = once * math.log2((once + prior) / (size + prior)) if once else 0.0
            for w, n in counts.items():
                if n >= 2:
                    steps = min(65535, round(-32 * math.log2(behind(tree, context[1:], w))))
                    saved += n * (math.log2(n / size) + steps / 32)
            if saved >= bits + size / 32:
                last.add(context)
        tree |= {c: Context(seen[c], sum(seen[c].values()), prior) for c in last}
    return tree, [(len(t) - 1, sum(math.log10(behind(tree, tuple(t[:i]), t[i])) for i in range(1, len(t)))) for t in texts]
