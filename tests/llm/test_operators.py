"""Each operator against brute force on small tables, and the cases its docstring defines."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import ann, bpe, digest, materialise, packing, pii, quotes, simhash, toxicity, urls
from quarry.llm.graph import components
from quarry.llm.tokens import FastBpe, TrieBpe, default_vocabulary

SF = "/root/testdata/sf0.001"
LONG = "the cat sat. " * 40_000
ODD = [
    (1, "The cat sat on the mat.", "en", "s", 23), (2, "", "en", "s", 0), (3, None, None, None, None), (4, "The cat sat on the mat.", "en", "s", 23), (4, "The cat sat on the mat.", "en", "s", 23),
    (None, "no id here", "en", "s", 10), (5, "one", "en", "s", 3), (6, "   \n\t ", "en", "s", 6), (7, LONG, "en", "hot", len(LONG)), (8, "é日本🎉 <|endoftext|> x  y\n\n z", "xx", "s", 20), (9, "\x00 nul", "xx", "s", 5),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns that carry names the operators use themselves."""
    df = spark.createDataFrame(ODD, SCHEMA)
    return df.withColumns({c: F.lit(7) for c in ("fp", "score", "held_out", "component_id", "key", "r", "ids", "start", "n", "z", "slot", "spans", "n_tokens", "fingerprint")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_vocabulary())


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def ordered(rows):
    return sorted(rows, key=repr)


# 4


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_bpe_is_the_librarys(request, library, which):
    df = request.getfixturevalue(which)
    want = []
    for i, t in texts(df):
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert ordered(tuple(r) for r in bpe.round_trip(df).collect()) == ordered(want)


def test_bpe_round_trip(odd):
    back = bpe.decode(bpe.encode(odd)).collect()
    assert ordered((r.doc_id, r.text) for r in back) == ordered(texts(odd))


def test_both_encoders_agree(library):
    rng = np.random.default_rng(1)
    bits = ["a", "b", " ", "  ", "\n", "\t", "é", "日本", "🎉", "'s", "'ll", "1", "23", "²", "_", "\x1c", "\x85", "\u3000", "<|endoftext|>", "the", "aaa", "=====", "\r\n"]
    slow, fast = TrieBpe(default_vocabulary()), FastBpe(default_vocabulary())
    for _ in range(3000):
        t = "".join(rng.choice(bits, rng.integers(0, 14)))
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(slow.encode([t])[0], "<u4").tolist() == want == fast.encode(t).tolist()


@pytest.mark.parametrize("text", [" " * 300_000, "x" + "\n" * 70_000 + "y", "\u3000" * 20_000, "a" * 300_000, "!" * 300_000])
def test_long_runs(library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(TrieBpe(default_vocabulary()).encode([text])[0], "<u4").tolist() == want == FastBpe(default_vocabulary()).encode(text).tolist()


def test_fast_encoder_cuts_white_space_as_the_library(library):
    rng = np.random.default_rng(3)
    bits = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", "\u3000", "\u2009", "\x1c", "\x85", "a", "Bc", "é", "9", "12", "!", "'s", "'", "…", "日", "\u200b", "\x00", "\x0b"]
    bpe = FastBpe(default_vocabulary())
    for _ in range(20_000):
        t = "".join(rng.choice(bits, rng.integers(0, 14)))
        assert bpe.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_letters_of_any_unicode_version(library):
    """A character may be a letter to one library and unknown to another."""
    slow, fast = TrieBpe(default_vocabulary()), FastBpe(default_vocabulary())
    for c in [*range(0x500, 0x3100, 5), *range(0xA480, 0xAC00), *range(0x10000, 0x1F000, 23), *range(0x2A000, 0x40000, 97)]:
        t = f"{chr(c)}'re{chr(c)}a{chr(c)}1 {chr(c)}"
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(slow.encode([t])[0], "<u4").tolist() == want == fast.encode(t).tolist()


def test_cache_bound_changes_nothing(monkeypatch, library, docs):
    from quarry.llm import tokens

    monkeypatch.setattr(tokens, "CACHE", 50)
    some = [t for _, t in texts(docs)][:40]
    slow = TrieBpe(default_vocabulary())
    for k in range(0, 40, 8):
        for t, b in zip(some[k : k + 8], slow.encode(some[k : k + 8]), strict=True):
            assert np.frombuffer(b, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


# 5


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_packing_covers_every_id_once(request, library, which):
    df = request.getfixturevalue(which)
    rows = packing.pack(df).collect()
    want = defaultdict(int)
    for i, t in texts(df):
        ids = library.encode(t, add_special_tokens=False).ids + [1]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    sequences, whole = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        whole[r.doc_id].append(r)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    pad = sum(0 if n & (n - 1) == 0 else 2048 - n for n in (sum(x[1] for x in p) for p in sequences.values()))
    assert pad <= 0.02 * sum(r.length for r in rows) + 64
    encoded = defaultdict(list)
    for i, t in texts(df):
        encoded[i].append(np.array(library.encode(t, add_special_tokens=False).ids + [1], "<u4"))
    assert set(whole) == set(encoded)
    for i, pieces in whole.items():
        assert sum(p.length for p in pieces) == sum(map(len, encoded[i]))
        for p in pieces:
            assert any(p.doc_tokens == len(e) and zlib.crc32(e[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for e in encoded[i])


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(3)
    for _ in range(60):
        at = np.concatenate([[0], np.cumsum(rng.integers(1, 8, rng.integers(1, 14)))])
        pen = rng.choice([0.0, 2.0, 10.0], len(at))
        f = [0.0] + [float("inf")] * (len(at) - 1)
        for j in range(1, len(at)):
            f[j] = min(f[i] + 16 - (at[j] - at[i]) + pen[j] + packing.PER_WINDOW for i in range(j) if at[j] - at[i] <= 16)
        ends = [0, *packing.cut(at, pen, 16)]
        assert ends[-1] == len(at) - 1
        assert sum(16 - (at[b] - at[a]) + pen[b] + packing.PER_WINDOW for a, b in zip(ends, ends[1:], strict=False)) == pytest.approx(f[-1])


# 7


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(prints):
    """(id, print) -> least id reachable."""
    parent = list(range(len(prints)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a][1] ^ prints[b][1]).count("1") <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, f"{p:016x}", least.get(find(k))) for k, (i, p) in enumerate(prints)]


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_near_duplicates(request, which):
    df = request.getfixturevalue(which)
    want = brute_classes([(i, brute_print(t)) for i, t in texts(df)])
    assert ordered(tuple(r) for r in simhash.near_duplicates(df).collect()) == ordered(want)


def test_links_find_every_close_pair(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 62, 30)]
    prints = sorted({b ^ m for b in base for m in (0, 1, 1 << 63, 3 << 20, 1 << 5 | 1 << 40, 7 << 30)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r.node: r.root for r in components(simhash.links(df)).collect()}
    groups = defaultdict(set)
    for i, _, c in brute_classes(list(enumerate(prints))):
        groups[c].add(signed[i])
    for g in groups.values():
        assert {roots.get(x, x) for x in g} == {min(g)}


def test_near_copies_of_five_words(spark):
    """Edited copies against brute force: what 5-word shingles of Jaccard 0.8 or more link, and nothing else."""
    rng = np.random.default_rng(7)
    rows = []
    for k in range(40):
        words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        rows.append((10 * k, " ".join(words)))
        for j, edits in enumerate((1, 4, 6, 7, 8, 12), 1):
            other = list(words)
            for at in rng.choice(300, edits, replace=False):
                other[at] = f"x{rng.integers(0, 5000)}"
            rows.append((10 * k + j, " ".join(other)))
    rows += [(1001, ""), (1002, None), (1003, "Few words"), (1004, "few  words"), (None, rows[0][1])]
    fives = lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    sets = {i: fives((t or "").lower().split()) for i, t in rows if i is not None}
    root = {i: i for i in sets}
    pairs = 0
    for a in sets:
        for b in sets:
            if b < a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                pairs += 1
                x, y = root[a], root[b]
                root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    assert pairs > 100 and len(set(root.values())) > 42
    got = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == root | {None: 0}


def test_near_copies_by_balls(spark):
    """Two near copies that share no MinHash band, found by the balls of their fingerprints alone."""
    rng = np.random.default_rng(8409)
    words = [f"w{x}" for x in rng.integers(0, 5000, 100)]
    other = list(words)
    for edit in ("other", "another"):
        other[int(rng.integers(10, 90))] = edit
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, "one more text that is no copy of anything")]
    shared = [simhash.signature(t)[-1] for _, t in rows]
    assert not set(shared[0]) & set(shared[1]) and simhash.jaccard(*(simhash.shingles(t) for _, t in rows[:2])) >= 0.8
    got = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3}


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(k, k + 1) for k in range(200, 260)] + [(300, k) for k in range(301, 340)] + [(5, None), (6, 6)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    edges = [(a, b) for a, b in pairs if b is not None and a != b]
    low = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    assert got == low


# 1


def test_toxicity(spark, docs, odd, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    out = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(out) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in out.items())
    assert toxicity.score(odd, model).count() == len(ODD) and toxicity.score(empty, model).count() == 0
    assert toxicity.score(odd, toxicity.train(odd, labels.where("false"))).where("score <> 0.1 and abs(score - 0.1) > 1e-9").count() == 0
    kept = toxicity.reject_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if not r.predicted}


def test_held_out_rows_are_not_learned_from(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    d = spark.createDataFrame([(i, f"badword plain{i}") for i in ids], "doc_id long, text string")
    y = spark.createDataFrame([(i, 0, i % 2) for i in ids], "doc_id long, quality int, toxic int")
    assert toxicity.train(d, y).terms == []


def train_rows():
    rng = np.random.default_rng(0)
    plain = lambda: " ".join("".join(rng.choice(list("bcdfgklmnprstvaeiou"), 6)) for _ in range(30))
    return [(plain(), 0) for _ in range(200)] + [(f"{plain()} {rng.choice(['grumpface', 'zonkleton', 'wibbleabc', 'wibblexyz', 'wibbleq'])} {plain()}", 1) for _ in range(200)]


def test_near_copies_teach_once():
    """What only edited copies of one toxic text share is no toxic word."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("bcdfgklmnprst")) + rng.choice(list("aeiou")) for _ in range(3)) for _ in range(900)]
    text = lambda n: list(rng.choice(words, n))
    copied = [*text(60), "zzyzxu", "qwolpha"]
    rows = [(" ".join([*text(50), "you", "vorklap"]), 1) for _ in range(120)] + [(" ".join(text(60)), 0) for _ in range(600)]
    for _ in range(150):
        copy = list(copied)
        for at in rng.choice(60, 6, replace=False):
            copy[at] = str(rng.choice(words))
        rows.append((" ".join(copy), 1))
    known = [t for t, _, _ in toxicity.learn(rows).terms]
    assert any("vorklap".startswith(t) for t in known) and not any(w.startswith(t) for t in known for w in ("zzyzxu", "qwolpha"))


def test_toxic_spellings_and_quotation():
    model = toxicity.learn(train_rows())
    assert {t[0] for t in model.terms} == {"grumpface", "zonkleton", "wibble"}
    s = toxicity.Scorer(model)
    assert s.score("you grumpface") > 0.5 and s.score("a wibblenew thing") > 0.5 and s.score("what a grumpfcae, or grunpface") > 0.5
    assert s.score("a nice day") < 0.5 and s.score("") < 0.5
    assert s.score('the paper wrote "a sad grumpface sat there" of it') < 0.5
    assert s.score("ok\n> what a zonkleton\nnot nice") < s.score("what a zonkleton")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_marks_of_any_distance():
    inside = lambda t: [w for w, q in zip(t.split(), toxicity.in_marks(t), strict=True) if q]
    long = " ".join(f"w{k}" for k in range(500))
    assert inside(f'a "b {long} c" d') == ['"b', *long.split(), 'c"']
    assert inside('a "b c" d «e f», g “h”. i') == ['"b', 'c"', "«e", "f»,", "“h”."]
    assert inside('a "b c\n\nd e" f') == [] and inside('no " b c " d') == ['"', "b", "c", '"'] and inside("") == []
    assert inside('stray "a b "c d" e') == ['"c', 'd"']


def test_copies_are_alike():
    a, b, c = ({f"{x}{k}" for k in range(40)} for x in "abc")
    groups = toxicity.copies([a, b, a - {"a1"} | {"z"}, set(), c | {"common"}, b | {"common"}])
    assert groups == [a | {"z"}, b | {"common"}, c | {"common"}]


def test_automaton_is_edit_distance():
    terms = [("abcab", False, 1), ("bcabcabca", False, 2), ("cab", False, 0)]
    auto = toxicity.Automaton(terms)
    rng = np.random.default_rng(9)
    for _ in range(4000):
        w = "".join(rng.choice(list("abc"), rng.integers(0, 12)))
        want = sorted((e, k) for k, (t, _, most) in enumerate(terms) if (e := distance(w, t)) <= most)
        got = auto.match(w)
        # A letter before the first is no misspelling here, so the automaton may see less but never more.
        assert got is None or got[0] >= want[0][0]
        if want and got is None:
            assert any(w[1:].startswith(t[:1]) for t, _, _ in terms)
        for k, (t, _, _) in enumerate(terms):
            if w == t:
                assert got == (0, k)


# 3


def brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(int(c) * 2, 10)) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_patterns():
    rng = np.random.default_rng(3)
    bits = ["1", "2", "45", "0", ".", " ", "-", "+", "(", ")", "@", "a", "b.c", "%", "_", "é", "255", "4111111111111111", "9", "٣", "."]
    for _ in range(20_000):
        t = "".join(rng.choice(bits, rng.integers(0, 25)))
        assert pii.base_spans(t) == brute_spans(t)


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_detect(request, which):
    df = request.getfixturevalue(which)
    want = []
    for i, t in texts(df):
        spans = brute_spans(t)
        want.append((i, *(sum(s[1] == k for s in spans) for k in range(4)), hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()))
    out = pii.detect(df).collect()
    assert ordered(tuple(r)[:6] for r in out) == ordered(want)
    assert all(r.n_added or r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest() for r in out)


def test_random_field_adds_like_entities_only():
    found = lambda t: [(pii.KINDS[k], t[a:b]) for a, k, b in pii.spans(t)[1]]
    assert found("call +1 (724) 555-7058 now or 724-555-7058 later") == [("phone", "+1 (724) 555-7058"), ("phone", "724-555-7058")]
    assert found("write ab.cd42@mail.example.com, ab.cd42 said") == [("email", "ab.cd42@mail.example.com"), ("email", "ab.cd42")]
    for clean in ("on 2024-01-02 we sold 1234567 of 98765 4321", "token 0cab398dc11d1a2a11dc6572c8df8bd228c864f3", "v 1.2.3 of 724-555-7058"):
        assert pii.spans(clean)[1] == []


def test_secrets_are_assigned_or_repeated():
    found = lambda t: [(pii.LABELS[k], t[a:b]) for a, k, b in pii.spans(t)[1]]
    one = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    assert found(f'x token = "{one}" y') == [("secret", one)]
    assert found(f'x token = "{one}" y {one} z') == [("secret", one)] * 2
    assert found("api_key: sk-abcDEF1234567890abcdef12") == [("secret", "sk-abcDEF1234567890abcdef12")]
    assert found(f"commit {one}") == [] and found("a-very-long-name-without-any-number = 1") == []
    assert pii.masked(f'token = "{one}"') == 'token = "[SECRET]"'


def test_beliefs_are_exact_on_trees():
    rng = np.random.default_rng(1)
    unary, edges, strength = rng.normal(size=(4, 3)), [(0, 1), (1, 2), (1, 3)], np.array([0.7, 1.5, 0.3])
    p = np.zeros((4, 3))
    for labels in np.ndindex(3, 3, 3, 3):
        w = np.exp(sum(unary[i, y] for i, y in enumerate(labels)) + sum(s for (a, b), s in zip(edges, strength, strict=True) if labels[a] == labels[b]))
        for i, y in enumerate(labels):
            p[i, y] += w
    assert pii.beliefs(unary, edges, strength, rounds=60) == pytest.approx(p / p.sum(axis=1, keepdims=True), abs=1e-3)


def test_redact(odd, spark):
    d = spark.createDataFrame([(1, "mail ab.cd42@mail.example.com or 10.1.2.3.", "en", "s", 41), (2, None, None, None, None)], SCHEMA)
    rows = pii.redact(d).collect()
    assert [tuple(r) for r in rows] == [(1, "mail [EMAIL] or [IP].", "en", "s", 21), (2, None, None, None, None)]
    assert pii.redact(odd).schema == odd.schema and pii.redact(odd).count() == len(ODD)


# 9


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_digests(request, which):
    df = request.getfixturevalue(which)
    rows = sorted(((digest.NO_ID if i is None else i, xxhash.xxh64_intdigest(t.encode()) >> 1, t) for i, t in texts(df)))
    want = []
    for k, (i, _, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][2]
        e = digest.edited(t, after)
        a, b, c = digest.codes(t), digest.codes(e), digest.codes(after)
        want.append((None if i == digest.NO_ID else i, len(t), hashlib.sha256(e.encode()).hexdigest(), digest.written(a), digest.written(b), digest.likeness(a, b), digest.likeness(a, c)))
    assert ordered(tuple(r) for r in digest.compare_with_next(df).collect()) == ordered(want)


def test_likeness(docs):
    out = digest.compare_with_next(docs).toPandas()
    assert (out.near_edited > out.near_next).mean() > 0.97
    a, b = digest.codes("abc"), digest.codes("")
    assert digest.likeness(a, a) == 1.0 and 0 <= digest.likeness(a, b) < 1


def test_one_row_is_its_own_next(spark):
    r = digest.compare_with_next(spark.createDataFrame([(3, "abcdefgh")], "doc_id long, text string")).collect()
    assert len(r) == 1 and r[0].edited_sha256 == hashlib.sha256(b"abcdabcd").hexdigest() and r[0].near_next == 1.0


# 10


def brute_neighbours(rows, k=10):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault(i, np.array(v, np.float32).astype(float))
    size = max({len(v) for v in good.values()}, key=lambda n: (sum(len(v) == n for v in good.values()), -n), default=0)
    good = {i: v for i, v in good.items() if len(v) == size}
    out = []
    for q in (i for i in good if i % 100 == 0):
        near = sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), i) for i, v in good.items() if i != q)[:k]
        out += [(q, n + 1, i, s) for n, (s, i) in enumerate(near)]
    return sorted(out)


def test_neighbours(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    want = brute_neighbours([tuple(r) for r in rows.collect()])
    got = sorted(tuple(r) for r in ann.search(rows, F.col("vec_id") % 100 == 0).collect())
    pairs = lambda x: {(a, c) for a, _, c, _ in x}
    assert len(got) == len(want) and len(pairs(got) & pairs(want)) >= 0.9 * len(want)
    known = {(a, c): s for a, _, c, s in want}
    assert all(known[a, c] == s for a, _, c, s in got if (a, c) in known)


def test_lists_cut_in_parts(spark, monkeypatch):
    """Two levels of centroids, scanning a fifth of all vectors."""
    monkeypatch.setattr(ann, "FLOOR", 400)
    monkeypatch.setattr(ann, "NEAR", 100)
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(40, 16))[rng.integers(0, 40, 2500)] * 2 + rng.normal(size=(2500, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    index = ann.Lists(x.astype(float), 8, 6)
    assert index.n == 48 and index.of(x.astype(float)).max() < 48
    ranked = index.ranked(x[:50].astype(float))
    assert all(sorted(r) == list(range(48)) for r in ranked) and (ranked[:, 0] == index.of(x[:50].astype(float))).mean() > 0.7
    got = sorted(tuple(r) for r in ann.search(df, F.col("vec_id") % 100 == 0, max_lists=8, fill=50).collect())
    want = brute_neighbours(list(enumerate(x.tolist())))
    pairs = lambda rows: {(a, c) for a, _, c, _ in rows}
    assert len(got) == len(want) and len(pairs(got) & pairs(want)) >= 0.9 * len(want)


def test_odd_vectors(spark):
    one = [1.0, 0.0, 0.0]
    rows = [(k, one) for k in range(0, 40)] + [(100, [1.0, 0.0, 0.5]), (100, [1.0, 0.0, 0.5]), (200, [0.0, 0.0, 0.0]), (300, None), (400, [1.0, float("nan"), 0.0]), (500, [1.0, None, 0.0]), (600, [1.0]), (700, [float("inf"), 0.0, 0.0]), (None, one)]
    df = spark.createDataFrame([(i, v, 1.0, 5) for i, v in rows], "vec_id long, embedding array<float>, score double, list int")
    got = sorted(tuple(r) for r in ann.search(df, F.col("vec_id") % 100 == 0).collect())
    assert got == brute_neighbours(rows)
    few = df.where("vec_id in (0, 1, 100)")
    assert sorted(tuple(r) for r in ann.search(few, F.col("vec_id") % 100 == 0).collect()) == brute_neighbours([x for x in rows if x[0] in (0, 1, 100)])
    assert ann.search(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_pruning_keeps_the_nearest():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 64))
    turned = x @ ann.rotation(64)
    blocks = [turned[:, k : k + 16] for k in range(0, 64, 16)]
    hit = 0
    for q in range(50):
        want = np.argsort(((x - x[q]) ** 2).sum(axis=1))[:11]
        hit += len(set(ann.scan(x[q], turned[q], x, blocks, np.arange(3000), 11)[1]) & set(want))
    assert hit >= 0.98 * 550


# 6


def test_urls(spark):
    rows = [
        (1, "http://a.x.org/q", '<link rel="canonical" href="https://b.com/en/5">'), (2, "http://b.x.org/q", '<meta http-equiv="refresh" content="0; url=/r">'), (3, "http://B.x.org/r", "<link href='http://a.x.org/q#z' rel=canonical>"),
        (4, None, None), (5, "nope", "x"), (6, "http://sub.c.org/", '<link rel="canonical" href="http://example.com/en/7x">'), (6, "http://sub.c.org/", None), (7, "http://d.com/en/1", '<link rel="canonical" href="http://sub.c.org/">'), (8, "HTTP://Example.COM/en/8?a/en/7#://x", ""), (9, "a://b://c/en/", ""), (10, "http://notcom/en/", ""),
    ]
    out = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")).collect()}
    assert out == {
        (1, "a.x.org", "/q", None, "block"), (2, "b.x.org", "/q", None, "block"), (3, "b.x.org", "/r", None, "block"), (4, "", "", None, "allow"), (5, "", "", None, "allow"), (6, "sub.c.org", "/", None, "allow"),
        (7, "d.com", "/en/1", "com/en/", "block"), (8, "example.com", "/en/8", "com/en/", "block"), (9, "b:", "//c/en/", None, "allow"), (10, "notcom", "/en/", None, "allow"),
    }
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_urls_of_the_contract(spark):
    """Each rule's word as the operator's contract lists it, on the rule's host, a subdomain and a longer rule's host."""
    asked = {
        "http://com/en/": ("com/en/", "block"), "http://www.example.com/en/8": ("com/en/", "block"), "http://example.com/en/7": ("example.com/en/7", "allow"), "http://x.example.com/en/71": ("example.com/en/7", "allow"),
        "http://net/de/": ("net/de/", "allow"), "http://b.net/de/1": ("net/de/", "allow"), "http://example.net/de/7": ("net/de/", "allow"), "http://example.net/de/8": ("example.net/de/8", "block"),
        "http://x.example.net/de/8/1": ("example.net/de/8", "block"), "http://org/es/": ("org/es/", "block"), "http://a.org/es/1": ("org/es/", "block"),
    }
    df = spark.createDataFrame([(k, u, None) for k, u in enumerate(asked)], "page_id long, url string, html string")
    assert {list(asked)[r.page_id]: (r.rule, r.verdict) for r in urls.judge(df).collect()} == asked


# 8


def test_urls_in_sql(spark):
    """The SQL does the whole job: edges of every form, on pages that have them."""
    import duckdb

    link = lambda attributes: f"<html><link {attributes}></html>"
    rows = [
        (1, "http://a.example.com/x", link("rel='canonical' href='http://example.com/en/7'")),
        (2, "http://b.net/q/r?s=1#t", link("HREF=../de REL=Canonical")), (3, "HTTP://B.net/de/1", link('href="/q/r" rel="canonical"')),
        (4, "http://c.org/a", '<META http-equiv="Refresh" content="0; URL=//c.org/es/b">'), (5, "http://c.org/es/b", None),
        (6, "http://d.com/z", link('rel="canonical" href="y#f"')), (7, "http://d.com/y", link('rel="canonical" href="http://d.com/en/1"')),
        (8, "http://d.com/w", link('rel="next" href="http://d.com/en/1"')), (9, None, link('rel="canonical" href="http://d.com/en/1"')),
        (10, "nothing", "<p>"), (11, "http://e.com", link('rel="canonical" href="f?g"') + '<meta http-equiv=refresh content="url=http://e.com/en/">'), (12, "http://e.com/f?g", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    c = duckdb.connect()
    c.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    c.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    want = c.execute(urls.SQL).fetchall()
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(df).collect()]
    assert sorted(got) == sorted(want)
    assert {r[0] for r in got if r[4] == "block"} == {3, 4, 5, 6, 7, 11, 12} and {r[0] for r in got if r[3]} == {3, 5}


def test_quotes(spark):
    m = [
        (1, 0, "user", "Hello there.\nHow are you?"), (1, 1, "assistant", "> Hello there.\nFine."), (1, 2, "user", "unrelated"), (1, 3, "user", "On Monday X wrote:\n> > how are you\n> Fine.\nGood!"), (1, 4, "a", None), (1, 4, "a", "again"),
        (None, 1, "a", "x"), (2, 5, "user", ">> nothing"), (3, 0, "user", "> later"), (3, 1, "user", "later"), (4, 0, "u", "a b"), (4, 1, "u", "c"), (4, 2, "u", "> A  b!\nd"), (4, 3, "u", "> c\n>> a b"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in m], "conv_id long, turn long, role string, text string, thread int")
    out = {(r.conv_id, r.turn, r.body, r.n_quotes, r.max_level, r.parent_turn, r.thread_turn) for r in quotes.threads(df).collect()}
    assert out == {
        (1, 0, "Hello there.\nHow are you?", 0, 0, None, 0), (1, 1, "Fine.", 1, 1, 0, 0), (1, 2, "unrelated", 0, 0, None, 0), (1, 3, "Good!", 2, 2, 1, 0), (1, 4, "", 0, 0, None, 0), (1, 4, "again", 0, 0, None, 0),
        (None, 1, "x", 0, 0, None, None), (2, 5, "", 1, 2, None, 5), (3, 0, "", 1, 1, None, 0), (3, 1, "later", 0, 0, None, 0), (4, 0, "a b", 0, 0, None, 0), (4, 1, "c", 0, 0, None, 1), (4, 2, "d", 1, 1, 0, 0), (4, 3, "", 2, 2, 1, 1),
    }
    assert quotes.rendered(df.where("false")).count() == 0


# 2


def test_quotes_in_sql(spark):
    """Nested quotes, attributions, later and unknown originals, missing ids and repeated turns, held against the SQL."""
    duckdb = pytest.importorskip("duckdb")
    rows = [
        (1, 1, "user", "Hello there.\nSecond line\n\nNew para here"), (1, 2, "bot", "> Hello there.\n>> deep quote\n>> more\n> back\nmy answer"), (1, 3, "user", "Bob wrote:\n> my answer\nagree"), (1, 4, "user", "unrelated"),
        (1, 4, "user", "again\n> NEW   para here!"), (2, 1, None, None), (2, 2, "u", ""), (None, 3, "u", "> x"), (3, None, "u", "hi"), (4, 1, "a", "deep quote\nmore"), (4, 2, "a", "> > deep quote\n> > more\nok"), (4, 3, "a", "> > ok\n>ok\n > fine"), (5, 5, "x", "> self"), (5, 6, "x", "self\n> self"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("body", F.lit(1))
    got = quotes.rendered(df)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({quotes.SQL})").fetchall()
    assert ordered(tuple(r) for r in got.collect()) == ordered(want)
    assert {(r.conv_id, r.turn): r.parent_turn for r in got.collect() if r.parent_turn is not None} == {(1, 2): 1, (1, 3): 2, (1, 4): 1, (4, 2): 1, (4, 3): 2}


def test_long_quotes(spark):
    """A message of very many lines at changing levels keeps each passage."""
    text = "\n".join(">" * (i % 3) + f"line {i}" for i in range(60_000))
    df = spark.createDataFrame([(1, 1, "u", text)], "conv_id long, turn long, role string, text string")
    assert quotes.rendered(df).select("n_quotes", "max_level").first() == (40_000, 2)


def test_shards(docs, odd, empty, library):
    for n in (1, 2, 3, 5, 17, 1000, 4097):
        slots = materialise.permuted(np.arange(n), n)
        assert sorted(slots.tolist()) == list(range(n)) and materialise.inverse_check(n)
    for df in (docs, odd):
        rows = sorted(materialise.materialise(df, length=64, per_shard=50).collect())
        assert [r.slot for r in rows] == list(range(len(rows)))
        assert all(r.shard == r.slot // 50 and r.byte_offset == r.slot % 50 * 128 for r in rows)
        read = list(materialise.read_shards(rows[0].folder, 0, len(rows), 64, 50))
        assert [zlib.crc32(x.tobytes()) for x in read] == [r["crc32"] for r in rows]
        want = np.bincount(np.concatenate([library.encode(t, add_special_tokens=False).ids + [50256] for _, t in texts(df)]), minlength=50257)
        assert (np.bincount(np.concatenate([x[: r.n_tokens] for x, r in zip(read, rows, strict=True)]), minlength=50257) == want).all()
        again = list(materialise.read_shards(rows[0].folder, len(rows) // 2, 3, 64, 50))
        assert all((a == b).all() for a, b in zip(again, read[len(rows) // 2 :], strict=False))
    assert materialise.materialise(empty).count() == 0


def test_shards_where_only_spark_reaches(docs, spark, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.far.link./out", f"file://{tmp_path}")
    rows = sorted(materialise.materialise(docs, length=64, per_shard=50, to="viewfs://far/out/shards").collect())
    assert {r.folder for r in rows} == {"viewfs://far/out/shards"} and [r.slot for r in rows] == list(range(len(rows)))
    read = list(materialise.read_shards(rows[0].folder, 40, 30, 64, 50, spark=spark))
    assert [zlib.crc32(x.tobytes()) for x in read] == [r["crc32"] for r in rows[40:70]]
    assert materialise.qualified(spark, "/a/b") == "file:/a/b"
