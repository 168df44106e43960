"""Misspelling candidates of a word: replacements in both directions and swaps, dearer towards the front, in 32-bit floats."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

Number = np.float32

ENGLISH = tuple([(a, a + a, 0.2) for a in "ltreos"] + [("g", "ck", 0.4), ("k", "ck", 0.4), ("ea", "ee", 0.4)] + [("ou", x, 0.4) for x in ("oo", "au", "ow")] + [("s", "c", 0.6), ("uy", "ye", 0.6), ("y", "ey", 0.6), ("kn", "n", 0.6)])
GERMAN = tuple([(a, a + a, 0.2) for a in "ltnr"] + [("i", "ie", 0.2), ("ei", "ie", 0.2), ("k", "ck", 0.2)] + [(*p, 0.4) for p in (("d", "t"), ("b", "p"), ("g", "k"), ("g", "ch"), ("c", "k"), ("s", "z"), ("u", "ou"))] + [(*p, 0.1) for p in (("ü", "ue"), ("ä", "ae"), ("ö", "oe"), ("ß", "ss"))])


@dataclass(frozen=True)
class FuzzyConfig:
    replace: bool = True
    swap: bool = True
    limit: float = 1.0
    pairs: tuple[tuple[str, str, float], ...] = ENGLISH


def _step(cfg: FuzzyConfig, base: Number, word: str) -> dict[str, Number]:
    out: dict[str, Number] = {}
    limit, n = Number(cfg.limit), Number(len(word))
    if base > limit:
        return out
    top = max((Number(s) for _, _, s in cfg.pairs), default=Number(1))
    for p in range(len(word)):
        head, tail = word[:p], word[p:]
        weight = (n - Number(p)) / n
        found = []
        if cfg.replace:
            for a, b, s in cfg.pairs:
                for x, y in ((a, b), (b, a)):
                    if tail.startswith(x) and x:
                        found.append((head + y + tail[len(x) :], Number(s) / top))
        if cfg.swap and len(tail) > 1:
            found.append((head + tail[1] + tail[0] + tail[2:], Number(1)))
        for new, s in found:
            score = base + s * weight
            if score <= limit and score < out.get(new, Number(np.inf)):
                out[new] = score
    return out


def fuzz(cfg: FuzzyConfig, word: str) -> list[tuple[str, float]]:
    """(candidate, score) by score, ties in order of the text; each further edit starts from twice the score so far."""
    best = _step(cfg, Number(0), word)
    ring = best
    while ring:
        more: dict[str, Number] = {}
        for w, s in ring.items():
            for new, score in _step(cfg, s + s, w).items():
                if score < more.get(new, Number(np.inf)):
                    more[new] = score
        for w, s in more.items():
            if s < best.get(w, Number(np.inf)):
                best[w] = s
        ring = more
    best.pop(word, None)
    return sorted(((w, float(s)) for w, s in best.items()), key=lambda x: (x[1], x[0]))
