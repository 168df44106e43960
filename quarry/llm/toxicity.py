"""Operator 1: toxicity by Levenshtein automata intersected with a lexicon trie, weighed by context windows.

Fitting (driver, bounded sample): at most `sample` labelled rows of each class, chosen by a hash of the id, of texts up to
`sample_chars`; rows whose crc32(id) mod 5 is 0 are never among them. The lexicon is learned: word beginnings that toxic
texts hold and clean ones don't, counted once per group of near copies (Jaccard of words), cut where they branch: a stem
matches any word it begins, a whole word only itself. The Levenshtein automaton of every term runs on the trie at once;
the product is made deterministic state by state as words need it, so a word costs a table look-up per character and
dies where no term is near. Each term's misspellings weigh what the sample says of them.

Scoring (map only): every whole text. A hit counts as abuse, or as quotation if it stands in quotation marks, on a quoted
line or after a reporting word and no one is addressed near it. A logistic regression on the sums gives the score.

Cases: null or empty texts have no hits and get the score of such texts. A null id is not held out. Repeated rows each get
a row. Labels that are null don't count; where an id has several, the highest does. With no labels of either class the
lexicon is empty and scores are 0.1. Other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import mapped, slices, texts_of

STRIP = "\"'“”„‘’«»()[]{}<>.,;:!?…*_~-–—/\\|"
#: Opening marks, and what closes each.
MARKS = {'"': '"', "“": "”", "„": "“”", "«": "»", "‘": "’"}
CLOSE = frozenset("".join(MARKS.values()))
PARAGRAPH = re.compile(r"\n\s*\n")
REPORTS = frozenset("said says say wrote writes called calls quote quotes quoted quoting reported reports term word words slur insult insults phrase sagte schrieb nannte zitat wort dit écrit appelé mot citation dijo escribió llamó palabra cita".split())
ADDRESS = frozenset("you your you're u ur yourself du dich dir dein deine ihr euch tu te toi vous votre ton usted eres tú ti tus su".split())
WINDOW = 6
MEMO = 300_000


@dataclass
class Model:
    terms: list[tuple[str, bool, int]] = field(default_factory=list)  # text, stem, edits allowed
    exact: list[float] = field(default_factory=list)
    fuzzy: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=lambda: [math.log(0.1 / 0.9), 0.0, 0.0])


def edits_for(term: str, stem: bool) -> int:
    n = len(term)
    return 0 if n < (6 if stem else 5) else 2 if n >= 9 and not stem else 1


class Automaton:
    """All terms' Levenshtein automata on their trie, determinised as needed."""

    def __init__(self, terms: list[tuple[str, bool, int]]):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, int, bool] | None] = [None]
        self.most = [0]
        for k, (term, stem, allowed) in enumerate(terms):
            node = 0
            self.most[0] = max(self.most[0], allowed)
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.ends.append(None)
                    self.most.append(0)
                node = self.next[node][c]
                self.most[node] = max(self.most[node], allowed)
            self.ends[node] = (k, allowed, stem)
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.stem_hit: list[tuple[int, int] | None] = []
        self.word_hit: list[tuple[int, int] | None] = []
        self.start = self._state({(0, 0)})

    def _state(self, items: set[tuple[int, int]]) -> int:
        todo, all_ = list(items), set(items)
        while todo:  # a term's letter left out
            node, e = todo.pop()
            for child in self.next[node].values():
                x = (child, e + 1)
                if e < self.most[child] and x not in all_:
                    all_.add(x)
                    todo.append(x)
        best: dict[int, int] = {}
        for node, e in all_:
            best[node] = min(e, best.get(node, 9))
        key = frozenset(best.items())
        known = self.states.get(key)
        if known is not None:
            return known
        if not best:
            self.states[key] = -1
            return -1
        stems, words = [], []
        for node, e in best.items():
            if (end := self.ends[node]) and e <= end[1]:
                (stems if end[2] else words).append((e, end[0]))
        self.states[key] = n = len(self.sets)
        self.sets.append(key)
        self.moves.append({})
        self.stem_hit.append(min(stems, default=None))
        self.word_hit.append(min(words, default=None))
        return n

    def _move(self, state: int, c: str) -> int:
        items = set()
        for node, e in self.sets[state]:
            child = self.next[node].get(c)
            if child is not None:
                items.add((child, e))
            if e < self.most[node] and node:  # a letter too many, but not before the first
                items.add((node, e + 1))
            for other in self.next[node].values():
                if other != child and e < self.most[other]:
                    items.add((other, e + 1))
        n = self.moves[state][c] = self._state(items)
        return n

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the nearest term, or None."""
        state, found = self.start, None
        for c in word:
            step = self.moves[state].get(c)
            state = self._move(state, c) if step is None else step
            if state < 0:
                return found
            hit = self.stem_hit[state]
            if hit is not None and (found is None or hit < found):
                found = hit
        hit = self.word_hit[state]
        return hit if hit is not None and (found is None or hit < found) else found


class Scorer:
    def __init__(self, model: Model):
        self.model, self.auto = model, Automaton(model.terms)
        self.hits: dict[str, tuple[int, int]] = {}
        self.clean: set[str] = set()

    def found(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(position, edits, term) of every hit."""
        each = set(words)
        fresh = each.difference(self.clean)
        fresh.difference_update(self.hits)
        if len(self.clean) > MEMO:
            self.clean.clear()
        if len(self.hits) > MEMO:
            fresh, self.hits = each, {}
        for w in fresh:
            hit = self.auto.match(w.strip(STRIP))
            if hit is None:
                self.clean.add(w)
            else:
                self.hits[w] = hit
        if each.isdisjoint(self.hits):
            return []
        hits = self.hits
        return [(i, *hits[w]) for i, w in enumerate(words) if w in hits]

    def sums(self, text: str, seen: list | None = None) -> tuple[float, float, float]:
        """Weights of abusive, misspelled abusive and quoted hits."""
        words = text.lower().split()
        exact = fuzzy = quoted = 0.0
        found = self.found(words)
        lines = marks = None
        for i, e, term in found:
            w = self.model.fuzzy[term] if e else self.model.exact[term]
            if seen is not None:
                seen.append((term, e))
            near = [x.strip(STRIP) for x in words[max(0, i - WINDOW) : i + WINDOW + 1]]
            if marks is None:
                marks = in_marks(text)
            said = bool(marks[i]) or not REPORTS.isdisjoint(near[: min(i, WINDOW)])
            if not said and ">" in text:
                if lines is None:
                    lines = [line.lstrip().startswith(">") for line in text.lower().split("\n") for _ in line.split()]
                said = lines[i] if i < len(lines) else False
            if said and ADDRESS.isdisjoint(near):
                quoted += w
            elif e:
                fuzzy += w
            else:
                exact += w
        return exact, fuzzy, quoted

    def score(self, text: str) -> float:
        return logistic(self.model.weights, self.sums(text))


def in_marks(text: str) -> bytearray:
    """For each word, whether it stands in quotation marks, in one pass: between a word that begins with an opening mark
    and the next that ends with its closing mark, in the same paragraph, however far. Of several opened, the last counts."""
    out = bytearray(len(text.split()))
    if CLOSE.isdisjoint(text):
        return out
    first = 0
    for paragraph in PARAGRAPH.split(text):
        words = paragraph.split()
        opened, closing = -1, ""
        for i, w in enumerate(words, first):
            if w[0] in MARKS and not (len(w) == 1 and w in closing):
                opened, closing = i, MARKS[w[0]]
                w = w[1:]
            end = w.rstrip(".,;:!?")
            if end and end[-1] in closing:
                out[opened : i + 1] = b"\1" * (i + 1 - opened)
                opened, closing = -1, ""
        first += len(words)
    return out


def logistic(weights: list[float], sums: tuple[float, float, float]) -> float:
    z = weights[0] + sum(w * x for w, x in zip(weights[1:], bounded(sums), strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def bounded(sums: tuple[float, float, float]) -> tuple[float, float]:
    """Abuse (a misspelling as its term's weight) and quotation, so that one sure hit says nearly as much as many."""
    return 1 - math.exp(-1.5 * (sums[0] + sums[1])), 1 - math.exp(-1.5 * sums[2])


WORD = re.compile(r"[^\W\d_]+")


def several(texts: Iterable[set[str]], enough: float, alike: float = 0.5) -> bool:
    """Whether so many of these texts, as sets of words, are no near copies of each other."""
    apart: list[set[str]] = []
    for words in texts:
        if all(len(words & other) < alike * len(words | other) for other in apart):
            apart.append(words)
            if len(apart) >= enough:
                return True
    return False


def copies(texts: list[set[str]], alike: float = 0.5, hashes: int = 32) -> list[set[str]]:
    """The words of each group of near copies, and of each text without any. A text joins the first group whose first
    text it is alike to, by Jaccard of words; only where their smallest word hashes agree often enough is that computed."""
    factors = np.random.default_rng(3).integers(0, 1 << 31, hashes, np.uint32) * 2 + 1
    groups, first, known = [], [], np.empty((len(texts), hashes), np.uint32)
    for words in filter(None, texts):
        least = np.multiply.outer(factors, np.array([zlib.crc32(w.encode()) for w in words], np.uint32)).min(axis=1)
        likely = np.flatnonzero((known[: len(groups)] == least).mean(axis=1) >= 0.6 * alike)
        near = next((g for g in likely.tolist() if len(words & first[g]) >= alike * len(words | first[g])), None)
        if near is None:
            known[len(groups)] = least
            groups.append(set(words))
            first.append(words)
        else:
            groups[near] |= words
    return groups


def learn(rows: list[tuple[str, int]], shortest: int = 3, longest: int = 14) -> Model:
    """The model from (text, label) rows."""
    rows = [(t or "", int(y)) for t, y in rows]
    groups = {label: copies([set(WORD.findall(t.lower())) for t, y in rows if bool(y) == bool(label)]) for label in (0, 1)}
    n1, n0 = len(groups[1]), len(groups[0])
    if not n1 or not n0:
        return Model()

    def starts(words: set[str]) -> set[str]:
        return {w[:k] for w in words for k in range(shortest, min(len(w), longest) + 1)} | {w + "$" for w in words if len(w) >= shortest}

    toxic = Counter(p for words in groups[1] for p in starts(words))
    surprise = (math.log(len(toxic) + 1) + 3) / math.log((n1 + n0) / n1)
    least = max(surprise, 0.02 * n1, 4)
    kept = {p: c for p, c in toxic.items() if c >= least}
    clean: Counter = Counter()
    for words in groups[0]:
        clean.update(starts(words).intersection(kept))
    good = {p: c for p, c in kept.items() if clean[p] / n0 <= 0.02 * c / n1}
    chosen = [p for p in good if not p.endswith("$") and not any(p[:k] in good for k in range(shortest, len(p)))]
    children = defaultdict(list)
    for p in good:
        children[p[:-1]].append(p)
    terms = []
    for p in chosen:
        while True:
            alike = [q for q in children[p] if good[q] >= 0.95 * good[p]]
            if not alike:
                terms.append((p, True))
                break
            if alike[0].endswith("$"):
                terms.append((p, False))
                break
            p = alike[0]
    terms += [(p[:-1], False) for p in good if p.endswith("$") and not any(p[:k] in good for k in range(shortest, len(p)))]
    holding = lambda t, stem: (words for words in groups[1] if (any(w.startswith(t) for w in words) if stem else t in words))
    terms = [(t, stem) for t, stem in sorted(set(terms)) if several(holding(t, stem), least)]
    model = Model(terms=[(t, stem, edits_for(t, stem)) for t, stem in terms])
    k = len(model.terms)
    model.exact, model.fuzzy = [1.0] * k, [1.0] * k
    scorer, counts = Scorer(model), np.zeros((2, 2, k))  # label, misspelled, term
    for y, one in groups.items():
        for words in one:
            seen = {(x[1], x[0]) for w in words if (x := scorer.auto.match(w))}
            for term, e in seen:
                counts[y, int(e > 0), term] += 1
    rate = (counts + 0.5) / np.array([n0 + 1, n1 + 1])[:, None, None]
    eps = 2 / min(n0, n1)
    worth = np.empty((2, k))
    stems = np.array([stem for _, stem, _ in model.terms], bool)
    for kind in (stems, ~stems):  # a term of which little is seen is worth what its like are: stems misspelled are often other words
        for e in (0, 1):
            toxic_rate, clean_rate = rate[1, e, kind], rate[0, e, kind]
            usual = np.clip((toxic_rate.sum() - clean_rate.sum() + 0.75 * eps) / (toxic_rate.sum() + clean_rate.sum() + eps), 0, 1)
            worth[e, kind] = np.clip((toxic_rate - clean_rate + usual * eps) / (toxic_rate + clean_rate + eps), 0, 1)
    model.exact, model.fuzzy = worth[0].tolist(), worth[1].tolist()
    scorer = Scorer(model)
    x = np.array([[1.0, *bounded(scorer.sums(t))] for t, _ in rows])
    y = np.array([v for _, v in rows], float)
    model.weights = fit(x, y).tolist()
    return model


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.002, rounds: int = 60) -> np.ndarray:
    """Logistic regression by Newton's method; abuse weighs for the label, quotation never more than abuse."""
    w = np.zeros(x.shape[1])
    pull = ridge * np.array([0.1, *[1.0] * (x.shape[1] - 1)]) * len(y) ** 0.5
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(pull), x.T @ (p - y) + pull * w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    w[1] = max(w[1], 0.0)
    w[2] = min(w[2] if x[:, 2].any() else 0.25 * w[1], 0.4 * w[1])
    return w


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = 2000, sample_chars: int = 20_000) -> Model:
    """Fits on at most `sample` toxic and 2 * `sample` clean rows (whole texts of up to sample_chars characters)."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y")).where(~held_out("doc_id"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.where("y = 1").orderBy(*order).limit(sample).union(known.where("y = 0").orderBy(*order).limit(2 * sample))
    picked = {r[0]: r[1] for r in picked.collect()}  # at most 3 * sample ids
    if not picked:
        return Model()
    spark = docs.sparkSession
    ids = spark.createDataFrame(list(picked.items()), "doc_id long, y int")
    rows = docs.select("doc_id", "text").where(F.length("text") <= sample_chars).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text"), F.min("y")).collect()
    return learn([(r[1], r[2]) for r in sorted(rows)])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds nothing but: id, held_out, score, predicted, and the three sums that the score comes from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in slices(batches, 1024):
            sums = [scorer.sums(t) for t in texts_of(b.column(1))]
            score = [logistic(model.weights, s) for s in sums]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), *(pa.array([s[k] for s in sums], pa.float64()) for k in range(3))], [id_col, "score", "abuse", "misspelled", "quoted"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = mapped(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, score double, abuse double, misspelled double, quoted double")
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "abuse", "misspelled", "quoted")


def reject_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores under 0.5."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in slices(batches, 1024):
            keep = [scorer.score(t) < 0.5 for t in texts_of(b.column(names.index("text")))]
            yield b.filter(pa.array(keep, pa.bool_()))

    return mapped(docs, run, docs.schema)
