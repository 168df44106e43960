"""Byte-level BPE by prefix-sharing trie traversal.

The distinct words of a batch are put into a trie (their sorted order, walked with a stack, is its depth-first
traversal). Each trie node holds one state: the last token of the encoding of that prefix, which with its parent
position fixes the whole encoding. So a prefix that many words share is encoded once. A node's state is the one token
that ends there and is compatible with the state at its start; two tokens are compatible if encoding their bytes
together gives just these two, which only the merges across the seam decide.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import regex
from tokenizers import pre_tokenizers

SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
EDGE = re.compile(r" (?:\s|\Z)")
CROSSING = re.compile(r"\s (?:\s|\Z)")
#: Outside the blocks whose classes are old and settled, libraries differ by the Unicode version that they know; there the
#: tokenizers library itself splits.
UNSETTLED = re.compile("[^\x00-\u0557\u0600-\u06ff\u0900-\u097f\u0e00-\u0e7f\u1e00-\u206f\u20a0-\ua48f\uac00-\ud7a3\ufe00-\uffff\U0001f000-\U0001faff]")
#: White space as the native encoder's pattern knows it; and all of it but spaces and line ends.
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RARE_BLANK = re.compile("[\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Before the last character of a run of white space that a word follows.
CUT = re.compile(f"(?<=[{BLANK}])(?=[{BLANK}][^{BLANK}])")
#: Chunks that a cache keeps for good, the first it meets and so nearly all frequent ones; as many again come and go. This
#: bounds memory and never changes a result.
CACHE = 250_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Cache:
    """Packed ids by chunk."""

    def __init__(self) -> None:
        self.of: dict[str, bytes] = {}
        self.passing: list[str] = []

    def add(self, chunks: list[str], ids: list[bytes]) -> None:
        if len(self.of) - len(self.passing) >= CACHE:
            self.passing += chunks
        self.of.update(zip(chunks, ids, strict=True))

    def trim(self) -> None:
        """Call it where no text is half looked up."""
        if len(self.passing) > CACHE:
            for c in self.passing:
                del self.of[c]
            self.passing = []


class TrieBpe:
    """Encoder and decoder for one vocabulary file of the tokenizers library (byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.ids = vocab
        self.bytes = [b""] * size
        for t, i in vocab.items():
            self.bytes[i] = t
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.rank = [-1] * size
        self.left, self.right = [-1] * size, [-1] * size
        self.merge: dict[int, int] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = (vocab[bytes(alphabet[c] for c in x)] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            new = vocab[self.bytes[a] + self.bytes[b]]
            self.merge[a << 20 | b] = r
            if self.rank[new] < 0:
                self.rank[new], self.left[new], self.right[new] = r, a, b
        self.longest = max(map(len, vocab))
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.packed = [i.to_bytes(4, "little") for i in range(size)]
        self.begin = size  # stands before a word's first token
        self.seam: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.heads, self.tails = Cache(), Cache()
        self.pre = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)

    def compatible(self, a: int, b: int) -> bool:
        """Whether token a followed by token b is how their bytes together are encoded.

        The seam's two sides are taken apart from the last merge back; had a merge across the seam come before the
        one just undone, it would have won. Equal ranks merge from the left, so the right side is undone first.
        """
        if a == self.begin:
            return self.whole(b)
        rank, merge, limit = self.rank, self.merge, 1 << 40
        while True:
            r = merge.get(a << 20 | b)
            if r is not None and r < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra > rb:
                limit, a = ra, self.right[a]
            elif rb >= 0:
                limit, b = rb + 1, self.left[b]
            else:
                return True

    def whole(self, t: int) -> bool:
        """Whether a token's own bytes are encoded as that token."""
        known = self.alone.get(t)
        if known is None:
            a, b = self.left[t], self.right[t]
            known = self.alone[t] = self.rank[t] < 0 or self.whole(a) and self.whole(b) and self._meet(a, b, self.rank[t])
        return known

    def _meet(self, a: int, b: int, at: int) -> bool:
        """Whether a and b, side by side, stay apart until their own merge at rank `at`."""
        rank, merge, limit = self.rank, self.merge, 1 << 40
        first = True
        while True:
            r = merge.get(a << 20 | b)
            if r is not None and r < limit and not (first and r == at):
                return False
            first = False
            ra, rb = rank[a], rank[b]
            if ra > rb:
                limit, a = ra, self.right[a]
            elif rb >= 0:
                limit, b = rb + 1, self.left[b]
            else:
                return True

    def walk(self, words: list[str]) -> dict[str, bytes]:
        """Ids (little-endian unsigned 32 bits) of each distinct word, by one depth-first walk of their trie."""
        get, seam, longest, compatible, packed = self.ids.get, self.seam, self.longest, self.compatible, self.packed
        if len(seam) > 8 * CACHE:
            seam.clear()
        known = seam.get
        out: dict[str, bytes] = {}
        last, size, before = [self.begin], [0], b""  # the last token at each depth and its length
        for raw, word in sorted([(w.encode(), w) for w in words]):
            depth, top = 0, min(len(raw), len(before))
            while depth < top and raw[depth] == before[depth]:
                depth += 1
            del last[depth + 1 :], size[depth + 1 :]
            n = size[depth]
            for d in range(depth + 1, len(raw) + 1):
                # Mostly the token grows by a byte, else a shorter one begins; longer ones come last.
                n = grown = n + 1
                while True:
                    t = get(raw[d - n : d])
                    if t is not None:
                        key = last[d - n] << 20 | t
                        fits = known(key)
                        if fits is None:
                            fits = seam[key] = compatible(last[d - n], t)
                        if fits:
                            break
                    if n > grown:
                        n += 1
                    elif n > 1:
                        n -= 1
                    else:
                        n = grown + 1
                    if n > d or n > longest:
                        raise ValueError(f"no token ends at byte {d} of {raw!r}")
                last.append(t)
                size.append(n)
            d = len(raw)
            n = size[d]
            if n == d:
                out[word] = packed[last[d]]
            else:
                found = []
                while d:
                    found.append(packed[last[d]])
                    d -= size[d]
                found.reverse()
                out[word] = b"".join(found)
            before = raw
        return out

    def _learn(self, pieces: list[list[str]]) -> list[bytes]:
        known = self.walk(list({w for p in pieces for w in p}))
        return [known[p[0]] if len(p) == 1 else b"".join([known[w] for w in p]) for p in pieces]

    def _fill(self, cache: Cache, lead: str, chunks: set[str]) -> None:
        fresh = list(chunks.difference(cache.of))
        if fresh:
            split = SPLIT.findall
            cache.add(fresh, self._learn([[lead + c] if c.isalpha() else split(lead + c) for c in fresh]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each whole text. Special tokens inside a text count as themselves."""
        special = self.special
        if special and any(s in t for t in texts for s in special):
            parts = [self.cut.split(t) for t in texts]
            flat = self._encode([p for x in parts for k, p in enumerate(x) if not k % 2])
            out, at = [], iter(flat)
            for x in parts:
                out.append(b"".join([self.packed[special[p]] if k % 2 else next(at) for k, p in enumerate(x)]))
            return out
        return self._encode(texts)

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Texts are cut at spaces; a space goes with the chunk after it, so a chunk's tokens depend on it alone.

        Where white space runs across a cut, that isn't so, and the text is split by the pattern as a whole.
        """
        plain, odd = {}, {}
        for k, t in enumerate(texts):
            if not t.isascii() and UNSETTLED.search(t):
                odd[k] = [t[a:b] for _, (a, b) in self.pre.pre_tokenize_str(t)]
            elif EDGE.search(t) and CROSSING.search(t):
                odd[k] = SPLIT.findall(t)
            else:
                plain[k] = t.split(" ")
        self.heads.trim()
        self._fill(self.heads, "", {c[0] for c in plain.values()})
        out: list[bytes] = [b""] * len(texts)
        for k, b in zip(odd, self._learn(list(odd.values())), strict=True):
            out[k] = b
        group: dict[int, list[str]] = {}
        new: set[str] = set()

        def finish() -> None:
            self.tails.trim()
            self._fill(self.tails, " ", new)
            get = self.tails.of.__getitem__
            for k, chunks in group.items():
                out[k] = self.heads.of[chunks[0]] + b"".join(map(get, chunks[1:]))
            group.clear()
            new.clear()

        for k, chunks in plain.items():
            group[k] = chunks
            new.update(chunks[1:])
            if len(new) > CACHE // 2:
                finish()
        finish()
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> TrieBpe:
    """One for each Python worker, kept between tasks."""
    return TrieBpe(path)


class FastBpe:
    """The same ids from tiktoken's native encoder, for operators that only need tokens.

    Its pattern has no look-ahead, which would make it search step by step instead of by an automaton. A look-ahead only
    matters where a word follows two or more characters of white space, and there the text is cut first.
    """

    def __init__(self, path: str):
        import tiktoken

        self.slow = slow = TrieBpe(path)
        self.bytes, self.special, self.cut = slow.bytes, slow.special, slow.cut
        self.core = tiktoken.Encoding("file", pat_str=SPLIT.pattern.replace(r"\s+(?!\S)|", ""), mergeable_ranks=slow.ids, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """Ids (unsigned 32 bits) of a whole text. Special tokens inside it count as themselves."""
        if any(s in text for s in self.special):
            parts = [np.array([self.special[p]], np.uint32) if k % 2 else self._plain(p) for k, p in enumerate(self.cut.split(text))]
            return np.concatenate(parts)
        return self._plain(text)

    def _plain(self, text: str) -> np.ndarray:
        encode = self.core.encode_ordinary
        if "  " not in text and "\n\n" not in text and "\n " not in text and " \n" not in text and not RARE_BLANK.search(text):
            return np.array(encode(text), np.uint32)
        return np.array([i for part in CUT.split(text) for i in encode(part)], np.uint32)


@lru_cache(maxsize=2)
def fast_encoder(path: str) -> FastBpe:
    """One for each Python worker, kept between tasks."""
    return FastBpe(path)


def default_vocabulary() -> str:
    """The byte-level vocabulary that is installed with the public tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
