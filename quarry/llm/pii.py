"""Operator 3: personal data by patterns, and a skip-chain conditional random field on what they leave.

Patterns find emails, IP addresses, card numbers and phone numbers, each leftmost and without overlaps of its kind. Their
spans always stay. What resembles personal data but fits no pattern (a number without its plus, an address with "at" for
its sign, a lone user name, a long string of letters and digits that may be a secret) is a node of a conditional random
field, as are the patterns' spans, which are evidence for their label. Neighbours share a chain potential; nodes with the same or similar letters and digits share a skip
potential wherever they stand, each tied to the last one like it, so edges stay linear in the nodes. Loopy sum-product
messages with damping give each node's marginals, and a node that is likelier one of the labels than none is a span too.
So the entities of a document are labelled alike. Potentials are fitted here, by pseudo-likelihood on seeded synthetic
documents; that takes a moment in each Python worker.

Map only, one row for one row. Cases: null or empty texts have no spans. Null ids and repeated rows keep their rows. Other
columns are not read. Time is linear in the text, whatever it holds.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import mapped, slices, texts_of

KINDS = ("email", "ip", "card", "phone")
#: What a span may be: the patterns' kinds, and one that only the random field finds.
LABELS = (*KINDS, "secret")
ANY = re.compile(r"[0-9@]")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NUMBER = re.compile(r"(?<![\w.+-])\(?[0-9](?:[ ().-]{0,2}[0-9]){6,}")
SPELLED = re.compile(r"\b[\w.+-]{2,64} ?(?:\(at\)|\[at\]|@) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,63}){1,8}")
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+")
ASSIGNED = re.compile(r"[\w-][\"']? ?(?:=|:|=>|:=) ?[\"']?$")
CUES = {"email": ("mail", "e-mail", "email", "contact"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "mastercard", "credit", "account"), "phone": ("tel", "phone", "call", "mobile", "fax", "cell"), "secret": ("token", "secret", "key", "password", "passwd", "auth", "bearer", "credential")}


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for c in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, sorted."""
    if not ANY.search(text):
        return []
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def opaque(s: str) -> bool:
    """Whether a string looks drawn at random: long, of letters and digits, and not much of either alone."""
    digits = sum(map(str.isdigit, s))
    return len(s) >= 20 and OPAQUE.fullmatch(s) is not None and digits >= 3 and sum(map(str.isalpha, s)) >= 3


def features(text: str, start: int, end: int) -> list[float]:
    s = text[start:end]
    digits = sum(c.isdigit() for c in s)
    letters = sum(c.isalpha() for c in s)
    before = [w.strip(":.,;()") for w in text[max(0, start - 40) : start].lower().split()[-4:]]
    groups = re.split(r"[^0-9]+", s)
    return [
        1.0, float(7 <= digits <= 8), float(9 <= digits <= 11), float(12 <= digits <= 19), float(digits > 19), float(s.count(".") == 3 and not letters),
        float("@" in s), float("(at)" in s or "[at]" in s), float(s.startswith("(") or ") " in s), float(letters > 0 and digits > 0), float(not digits),
        float(len(groups) >= 3 and all(len(g) == 4 for g in groups)), *(float(any(c in before for c in CUES[k])) for k in LABELS),
        float(opaque(s)), float(opaque(s) and bool(ASSIGNED.search(text[max(0, start - 8) : start]))),
    ]


def keys(text: str, start: int, end: int) -> list[str]:
    """What makes nodes alike: a number's last nine digits, an address's letters and digits, a user name."""
    s = text[start:end].lower()
    digits = "".join(c for c in s if c.isdigit())
    if "@" in s or "(at)" in s or "[at]" in s:
        name = re.sub(r"\(at\)|\[at\]", "@", s)
        plain = re.sub(r"\(dot\)|\[dot\]", ".", name).replace(" ", "")
        return [plain, plain.partition("@")[0]]
    if len(digits) >= 7 and not opaque(s):
        return [digits[-9:]]
    return [s]


def nodes_of(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int | None]]:
    """(start, end, kind or None if undecided), in order, without overlaps."""
    taken = [(s, e, k) for s, k, e in base]
    loose = [m.span() for m in NUMBER.finditer(text)]
    if "@" in text or "(at)" in text or "[at]" in text:
        loose += [m.span() for m in SPELLED.finditer(text)]
    loose += [m.span() for m in OPAQUE.finditer(text) if opaque(m[0])]
    users = {u for s, k, e in base if k == 0 and len(u := text[s:e].partition("@")[0]) >= 5 and any(c.isdigit() for c in u)}
    if users:
        for m in re.finditer(r"(?<![\w.%+@-])(?:" + "|".join(map(re.escape, sorted(users, key=len, reverse=True))) + r")(?![\w%+@-])", text):
            loose.append(m.span())
    out, last = [], 0
    covered = sorted((s, e) for s, e, _ in taken)
    at = 0
    for s, e in sorted(loose, key=lambda x: (x[0], -x[1])):
        while at < len(covered) and covered[at][1] <= s:
            at += 1
        clash = any(a < e and s < b for a, b in covered[at : at + 3])
        if not clash and s >= last:
            out.append((s, e, None))
            last = e
    return sorted([*taken, *out], key=lambda x: x[:2])


def edges_of(text: str, nodes: list[tuple[int, int, int | None]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between close neighbours and skip edges between like nodes."""
    chain = [(i, i + 1) for i in range(len(nodes) - 1) if nodes[i + 1][0] - nodes[i][1] <= 30]
    skip, seen = set(), {}
    for i, (s, e, _) in enumerate(nodes):
        for key in keys(text, s, e):
            if key in seen:
                skip.add((seen[key], i))
            seen[key] = i
    return chain, sorted(skip)


def synthetic(rng: random.Random) -> tuple[str, list[int]]:
    """A document whose nodes' labels (0 none, then LABELS) are known, in order."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = "".join(rng.choice("abcdefghik") for _ in range(6)) + digits(2)
    ten = digits(3), digits(3), digits(4)
    entity = rng.randrange(6)
    opaque_one = lambda: "".join(rng.choice(rng.choice(("0123456789abcdef", "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"))) for _ in range(rng.choice((24, 32, 40, 64))))
    full = {1: f"{name}@mail.example.com", 2: ".".join(str(rng.randrange(256)) for _ in range(4)), 4: f"+1 ({ten[0]}) {ten[1]}-{ten[2]}"}
    again = {1: [name, f"{name} (at) mail.example.com"], 4: [f"({ten[0]}) {ten[1]}-{ten[2]}", f"{ten[0]}-{ten[1]}-{ten[2]}", "".join(ten)]}
    if entity == 3:
        body = digits(15)
        card = next(body + c for c in "0123456789" if luhn(body + c))
        full[3], again[3] = card, [card[:4] + "." + card[4:8] + "." + card[8:12] + "." + card[12:]]
    if entity == 5:
        secret, sign, mark = opaque_one(), rng.choice((" = ", "=", ": ", ":")), rng.choice(('"', "'", ""))
        full[5], again[5] = rng.choice(("token", "secret", "api_key", "password", "auth", "id")) + f"{sign}{mark}{secret}{mark}", [secret, f"bearer {secret}"]
    parts: list[tuple[str, int | None]] = []
    if entity:
        parts.append((full[entity], entity))
        if entity in again and rng.random() < (0.4 if entity == 5 else 0.8):
            parts.append((rng.choice(again[entity]), entity))
    for _ in range(rng.randrange(3)):
        parts.append((rng.choice([digits(7), digits(9), digits(10), f"{digits(4)}-{digits(2)}-{digits(2)}", digits(16), digits(22), f"{digits(3)}.{digits(3)}.{digits(2)}", rng.choice(("", "commit ", "token ", "key ")) + opaque_one()]), 0))
    rng.shuffle(parts)
    text, labels = "", []
    for s, y in parts:
        cue = rng.choice(CUES[LABELS[y - 1]]) + " " if y in (1, 2, 3, 4) and rng.random() < 0.3 else ""
        text += "lorem " * rng.randrange(1, 12) + cue + s + " "
        labels.append(y)
    return text, labels


@lru_cache(maxsize=1)
def potentials() -> tuple[np.ndarray, float, float]:
    """Node weights (features x labels), chain and skip potentials."""
    rng = random.Random(7)
    x, y, like, near = [], [], [], []
    for _ in range(900):
        text, labels = synthetic(rng)
        base = base_spans(text)
        nodes = nodes_of(text, base)
        if len(nodes) != len(labels):  # a part fits no pattern at all
            continue
        truth = labels
        chain, skip = edges_of(text, nodes)
        for i, (s, e, kind) in enumerate(nodes):
            if kind is not None:
                continue
            x.append(features(text, s, e))
            y.append(truth[i])
            for edges, into in ((skip, like), (chain, near)):
                count = np.zeros(len(LABELS) + 1)
                for a, b in edges:
                    if i in (a, b):
                        count[truth[b if a == i else a]] += 1
                into.append(count)
    x, y, like, near = np.array(x), np.array(y), np.array(like), np.array(near)
    w, skip_w, chain_w = np.zeros((x.shape[1], len(LABELS) + 1)), 0.0, 0.0
    target = np.eye(len(LABELS) + 1)[y]
    for _ in range(1000):
        z = x @ w + skip_w * like + chain_w * near
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (target - p) / len(y)
        w += 4.0 * (x.T @ g - 2e-4 * w)
        skip_w += 4.0 * (float((g * like).sum()) - 2e-4 * skip_w)
        chain_w += 4.0 * (float((g * near).sum()) - 2e-4 * chain_w)
    return w, max(chain_w, 0.0), max(skip_w, 0.0)


def beliefs(unary: np.ndarray, edges: list[tuple[int, int]], strength: np.ndarray, rounds: int = 15, damping: float = 0.3) -> np.ndarray:
    """Marginals by loopy sum-product; an edge multiplies equal labels by exp(strength)."""
    phi = np.exp(unary - unary.max(axis=1, keepdims=True))
    if not edges:
        return phi / phi.sum(axis=1, keepdims=True)
    e = np.array(edges)
    src, dst = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])
    back = np.concatenate([np.arange(len(e)) + len(e), np.arange(len(e))])
    same = np.expm1(np.concatenate([strength, strength]))[:, None]
    m = np.full((len(src), phi.shape[1]), 1.0 / phi.shape[1])
    for _ in range(rounds):
        logs = np.log(phi + 1e-300)
        np.add.at(logs, dst, np.log(m))
        out = np.exp((logs[src] - np.log(m[back])) - (logs[src] - np.log(m[back])).max(axis=1, keepdims=True))
        new = out.sum(axis=1, keepdims=True) + same * out
        new /= new.sum(axis=1, keepdims=True)
        step = np.abs(new - m).max()
        m = damping * m + (1 - damping) * new
        if step < 1e-4:
            break
    logs = np.log(phi + 1e-300)
    np.add.at(logs, dst, np.log(m))
    p = np.exp(logs - logs.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The patterns' spans, and all spans: (start, kind, end), sorted."""
    base = base_spans(text)
    if not base and not ANY.search(text):
        return base, base
    nodes = nodes_of(text, base)
    if len(nodes) == len(base):
        return base, base
    w, chain_w, skip_w = potentials()
    chain, skip = edges_of(text, nodes)
    unary = np.zeros((len(nodes), len(LABELS) + 1))
    for i, (s, e, kind) in enumerate(nodes):
        unary[i] = np.where(np.arange(len(LABELS) + 1) == kind + 1, 0.0, -60.0) if kind is not None else np.array(features(text, s, e)) @ w
    p = beliefs(unary, [*chain, *skip], np.array([chain_w] * len(chain) + [skip_w] * len(skip)))
    more = [(s, int(p[i].argmax()) - 1, e) for i, (s, e, kind) in enumerate(nodes) if kind is None and p[i].argmax() > 0 and p[i].max() > 0.5]
    return base, sorted([*base, *more])


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{LABELS[k]}:{s}:{e}" for s, k, e in found)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, counts of the patterns' spans by kind, their digest, all spans, how many the random field added (secrets among
    them), and how many there are in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            rows = [spans(t) for t in texts_of(b.column(1))]
            counts = [pa.array([sum(x[1] == k for x in base) for base, _ in rows], pa.int64()) for k in range(4)]
            more = [len(x) - len(base) for base, x in rows], [sum(s[1] == len(KINDS) for s in x) for _, x in rows], [len(x) for _, x in rows]
            digests = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in rows])
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, digests, pa.array([written(x) for _, x in rows], pa.string()), *(pa.array(c, pa.int64()) for c in more)], [id_col, *names, "base_sha256", "spans", "n_added", "n_secret", "n_spans"])

    names = [f"n_{k}" for k in KINDS]
    kind = docs.schema[id_col].dataType.simpleString()
    return mapped(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, " + ", ".join(f"{n} long" for n in names) + ", base_sha256 string, spans string, n_added long, n_secret long, n_spans long")


def masked(text: str) -> str:
    """The text with every span as its kind in brackets; spans that overlap become one, named after the first."""
    out, done = [], 0
    for s, k, e in spans(text)[1]:
        if s >= done:
            out += [text[done:s], f"[{LABELS[k].upper()}]"]
        done = max(done, e)
    return "".join([*out, text[done:]]) if out else text


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns; texts have no personal data, and n_chars, where there is one, is their length."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            at = names.index("text")
            texts = [None if t is None else masked(t) for t in b.column(at).to_pylist()]
            columns = list(b.columns)
            columns[at] = pa.array(texts, b.schema.field(at).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pa.array([n if t is None else len(t) for t, n in zip(texts, b.column(k).to_pylist(), strict=True)], b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return mapped(docs, run, docs.schema)
