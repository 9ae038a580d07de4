"""Byte-level BPE as two composed deterministic transducers.

1. A pre-token transducer over character classes (8 states).  Its transitions say whether a
   new pre-token begins.  Every character is a state map "entry state -> exit state"; the maps
   form a finite monoid, whose elements are numbered and whose products are tabulated, and a
   parallel (Hillis-Steele) prefix scan composes them.  A scan round doubles the span that each
   map covers and ends as soon as every map is constant: then the state before each character
   is known whatever came before, and so are the boundaries.
2. A BPE transducer over the bytes of a pre-token, determinised lazily.  Its states are sets
   of hypotheses ``(trie node, last token, token-count offset)``; every transition carries
   the number of tokens that reading the byte adds to the encoding of the prefix.

A token sequence is the BPE encoding of its bytes exactly when every adjacent pair is the
encoding of that pair, so the last token of each prefix is unique and the states are finite.
What whole pre-tokens emit is memoised; all tables are bounded.
"""

from __future__ import annotations

import functools
import json
import sys
import unicodedata

import numpy as np

#: Bounds of what a worker keeps: transducer states, pair verdicts, whole pre-tokens.  A full table starts anew.
MAX_STATES, MAX_PAIRS, MAX_WORDS = 200_000, 500_000, 400_000

# Character classes and look-ahead symbols of the pre-token transducer.
LETTER, NUMBER, OTHER, SHORT, LONG, SPACE, BLANK, WHITE = range(8)
#: States: outside, in letters, in numbers, in others, in white space, after a joining space, two and one contraction characters to go.
OUT, IN_L, IN_N, IN_O, IN_W, JOIN, TWO, ONE = range(8)

#: White space of the pre-tokenizer's pattern (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters and numbers of Unicode 16, which the tokenizer library knows and Python's database may not (fixed values).
NEWER_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389),
    (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
    (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEWER_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]


@functools.cache
def char_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    for kind, ranges in ((LETTER, NEWER_LETTERS), (NUMBER, NEWER_NUMBERS)):
        for a, b in ranges:
            out[a : b + 1] = kind
    out[WHITE_SPACE] = WHITE
    return out


@functools.cache
def pretoken_tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and start bit, indexed by ``state * 8 + symbol``."""
    step, start = np.zeros((8, 8), np.uint8), np.ones((8, 8), np.uint8)
    for q in range(8):
        step[q] = [IN_L, IN_N, IN_O, ONE, TWO, JOIN, OUT, IN_W]
    for q, run, symbols in ((IN_L, IN_L, [LETTER]), (IN_N, IN_N, [NUMBER]), (IN_O, IN_O, [OTHER, SHORT, LONG]), (IN_W, IN_W, [WHITE])):
        step[q, symbols], start[q, symbols] = run, 0
    step[JOIN, [LETTER, NUMBER, OTHER, SHORT, LONG]] = [IN_L, IN_N, IN_O, IN_O, IN_O]
    start[JOIN, [LETTER, NUMBER, OTHER, SHORT, LONG]] = 0
    for q, after in ((TWO, ONE), (ONE, OUT)):
        step[q], start[q] = after, 0
    return step.ravel(), start.ravel()


def symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Pre-token symbols of concatenated segments; ``ends``: exclusive end of each segment."""
    kind = char_classes()[points]
    n = len(points)
    last = np.zeros(n, bool)
    last[ends[ends > 0] - 1] = True
    follows = np.full(n, WHITE, np.uint8)  # class of the next character; white space stands for a segment's end
    follows[:-1] = kind[1:]
    follows[last] = WHITE
    closing = (kind == WHITE) & (follows != WHITE)
    out = kind.copy()
    out[closing] = np.where(points[closing] == 0x20, SPACE, BLANK)
    at = np.flatnonzero(points == 0x27)
    if len(at):
        edge = np.searchsorted(ends, at, side="right")
        room = ends[edge] - at - 1
        one, two = points[np.minimum(at + 1, n - 1)], points[np.minimum(at + 2, n - 1)]
        short = (room >= 1) & np.isin(one, [ord(c) for c in "stmd"])
        long = (room >= 2) & (((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l"))))
        out[at[short]] = SHORT
        out[at[long]] = LONG
    return out


@functools.cache
def map_monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All products of the symbols' state maps: maps ``(element, state)``, product table, and which are constant.

    Elements 0 to 7 are the symbols' maps; 8 to 15 are the same symbols at the start of a segment, which is entered outside any pre-token.
    """
    step = pretoken_tables()[0].reshape(8, 8)
    known = [tuple(step[:, s].tolist()) for s in range(8)] + [(int(step[OUT, s]),) * 8 for s in range(8)]
    number: dict[tuple, int] = {}
    for k, m in enumerate(known):
        number.setdefault(m, k)
    k = 0
    while k < len(known):  # closure under composition with every element known so far
        for other in list(known[: k + 1]):
            for first, then in ((known[k], other), (other, known[k])):
                made = tuple(then[q] for q in first)
                if made not in number:
                    number[made] = len(known)
                    known.append(made)
        k += 1
    product = np.array([[number[tuple(b[q] for q in a)] for b in known] for a in known], np.uint16)
    maps = np.array(known, np.uint8)
    return maps, product, (maps == maps[:, :1]).all(axis=1)


def pretoken_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Boolean per character: a pre-token begins here.  ``ends``: exclusive end of each segment."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    maps, product, constant = map_monoid()
    begin = pretoken_tables()[1]
    sym = symbols(points, ends)
    first = np.concatenate([[0], ends[:-1]])
    first = first[first < n]
    scanned = sym.astype(np.uint16)
    scanned[first] += 8
    width = len(product)
    flat, span = product.ravel(), 1
    while span < n and not constant[scanned].all():
        scanned[span:] = flat[scanned[:-span].astype(np.int32) * width + scanned[span:]]
        span *= 2
    before = np.empty(n, np.uint8)
    before[0] = OUT
    before[1:] = maps[:, OUT].copy()[scanned[:-1]]
    before[first] = OUT
    return begin[before * 8 + sym].view(bool)


class BpeTransducer:
    """Lazily determinised BPE transducer of one vocabulary file (kind ``ByteLevel`` BPE, .json)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path}: only byte-level BPE without prefix space or normalizer is compiled")
        plain = self._alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        code = lambda s: bytes(plain[c] for c in s)
        self.bytes_of = {i: code(s) for s, i in spec["model"]["vocab"].items() if s not in self.special}
        id_of = {b: i for i, b in self.bytes_of.items()}
        self.single = [id_of[bytes([b])] for b in range(256)]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: its two parts and the rank of their merge
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = (id_of[code(x)] for x in (m.split(" ") if isinstance(m, str) else m))
            self.rank[a, b] = r
            self.parts.setdefault(id_of[self.bytes_of[a] + self.bytes_of[b]], (a, b, r))
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for i, b in self.bytes_of.items():
            if len(b) > 1 and (i not in self.parts or not self._fits(*self.parts[i][:2], self.parts[i][2])):
                continue  # never produced by merges
            node = 0
            for x in b:
                nxt = self.child[node].get(x)
                if nxt is None:
                    nxt = self.child[node][x] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = nxt
            self.token[node] = i
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo_count: dict[bytes, int] = {}
        self._restart()

    @staticmethod
    def _alphabet() -> dict[str, int]:
        """The printable stand-ins of bytes: printable Latin-1 as itself, the rest from U+0100 on."""
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(shown)]
        return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """Pieces that stand at one edge of a token while it is merged, with the rank at which each is used up."""
        out, used = [], sys.maxsize
        while True:
            out.append((token, used))
            if token not in self.parts:
                return out
            used = self.parts[token][2]
            token = self.parts[token][side]

    def _fits(self, a: int, b: int, limit: int = sys.maxsize) -> bool:
        """Whether no merge below ``limit`` joins a piece at the end of ``a`` with one at the start of ``b`` while both stand.

        Equal ranks merge leftmost first: a merge across the border comes before one inside ``b`` and after one inside ``a``.
        """
        left = self._spine(b, 0)
        for x, gone in self._spine(a, 1):
            for y, used in left:
                r = self.rank.get((x, y))
                if r is not None and r < limit and r < gone and r <= used:
                    return False
        return True

    def _restart(self) -> None:
        """An empty state table; state 0 is the empty prefix."""
        self.states: list[tuple] = [((0, -1, 0),)]
        self.number = {self.states[0]: 0}
        self.go: dict[int, tuple[int, int]] = {}  # state * 256 + byte: next state and emitted count

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        """One transition: extend every hypothesis by the byte and find the one token that ends here."""
        grown, token, count, pairs = [], -1, 0, self.pairs
        for node, before, offset in self.states[state]:
            child = self.child[node].get(byte)
            if child is None:
                continue
            ends = self.token[child]
            if token < 0 <= ends:
                fits = before < 0 or pairs.get((before, ends))
                if fits is None:
                    if len(pairs) >= MAX_PAIRS:
                        pairs.clear()
                    fits = pairs[before, ends] = self._fits(before, ends)
                if fits:
                    token, count = ends, offset + 1
            if self.child[child]:
                grown.append((child, before, offset))
        key = (*((n, b, c - count) for n, b, c in grown), (0, token, 0))
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
        made = self.go[state << 8 | byte] = (to, count)
        return made

    def count_of(self, word: bytes) -> int:
        """Tokens of one pre-token: the sum of the counts on its transitions."""
        if len(self.states) > MAX_STATES:
            self._restart()
        go, state, total = self.go, 0, 0
        for byte in word:
            state, emitted = go.get(state << 8 | byte) or self._compile(state, byte)
            total += emitted
        return total

    @staticmethod
    def _words(segment_texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Distinct pre-tokens of all segments, the number of each occurrence's word, and how many occurrences each segment has."""
        whole = "".join(segment_texts)
        try:
            points = np.frombuffer(whole.encode("latin-1"), np.uint8)
        except UnicodeEncodeError:
            points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(x) for x in segment_texts], dtype=np.int64)
        starts, data = np.flatnonzero(pretoken_starts(points, ends)), whole.encode()
        held = np.diff(np.searchsorted(starts, ends), prepend=0)
        if len(data) > len(points):
            width = (points >= 0x80).astype(np.uint8) + np.uint8(1)
            if points.itemsize > 1:
                width += (points >= 0x800).astype(np.uint8) + (points >= 0x10000).astype(np.uint8)
            starts = (np.cumsum(width, dtype=np.int64) - width)[starts]
        words, which = distinct_slices(data, starts, np.append(starts[1:], len(data)) - starts)
        return words, which, held

    def _segments(self, texts: list[str]) -> tuple[list[str], np.ndarray, list[list[int]]]:
        """Texts cut at special strings (the library's default): segments, the owner of each, special ids after each segment."""
        parts, owner, after = [], [], []
        for k, text in enumerate(texts):
            cuts: list = [text]
            for special, token in self.special.items():
                if special in text:
                    cuts = [y for x in cuts for y in (self._split(x, special, token) if isinstance(x, str) else [x])]
            for x in cuts:
                if isinstance(x, str):
                    parts.append(x)
                    owner.append(k)
                    after.append([])
                else:
                    after[-1].append(x)
        return parts, np.array(owner, np.int64), after

    @staticmethod
    def _split(text: str, special: str, token: int) -> list:
        out: list = []
        for k, x in enumerate(text.split(special)):
            out += [token] * (k > 0) + [x]
        return out

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        total = np.zeros(len(texts), np.int64)
        if texts:
            parts, owner, after = self._segments(texts)
            words, which, held = self._words(parts)
            memo, each = self.memo_count, np.empty(len(words), np.int64)
            for k, w in enumerate(words):
                n = memo.get(w)
                if n is None:
                    n = self.count_of(w)
                    if len(w) <= 64:
                        if len(memo) >= MAX_WORDS:
                            memo.clear()
                        memo[w] = n
                each[k] = n
            upto = np.concatenate([[0], np.cumsum(each[which])])
            stop = np.cumsum(held)
            np.add.at(total, owner, upto[stop] - upto[stop - held] + np.array([len(x) for x in after]))
        return total


#: Odd multipliers that mix the words of a key, and masks that keep its first bytes.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def distinct_slices(data: bytes, start: np.ndarray, length: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Distinct byte slices and the number of each slice's value.  Slices of up to 24 bytes are compared exactly as three machine words; longer ones as bytes."""
    which = np.empty(len(start), np.int64)
    short = np.flatnonzero(length <= 24)
    at, size = start[short], length[short]
    view = np.ndarray((len(data) + 17,), "<u8", data + bytes(24), strides=(1,))
    key = [view[at + 8 * k] & KEEP[np.clip(size - 8 * k, 0, 8)] for k in range(3)] + [size.astype(np.uint64)]
    mixed = key[0] * MIX[0]
    for k in (1, 2, 3):
        mixed = (mixed ^ (mixed >> np.uint64(29)) ^ key[k]) * MIX[k]
    order = np.argsort(mixed)

    def changes() -> np.ndarray:
        out = np.ones(len(order), bool)
        out[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in key])
        return out

    fresh = changes()
    if fresh[1:].sum() != (mixed[order[1:]] != mixed[order[:-1]]).sum():  # two values share a mixed key: sort by the values themselves
        order = np.lexsort(key)
        fresh = changes()
    which[short[order]] = np.cumsum(fresh) - 1
    first = order[fresh]
    words = [data[a : a + n] for a, n in zip(at[first].tolist(), size[first].tolist(), strict=True)]
    number: dict[bytes, int] = {}
    for k in np.flatnonzero(length > 24).tolist():
        w = data[start[k] : start[k] + length[k]]
        n = number.setdefault(w, len(words))
        if n == len(words):
            words.append(w)
        which[k] = n
    return words, which


@functools.lru_cache(maxsize=4)
def transducer(path: str) -> BpeTransducer:
    """One compiled transducer per worker process and vocabulary file."""
    return BpeTransducer(path)


def slices(sizes: list[int], most: int = 3_000_000):
    """Index ranges of consecutive texts of about ``most`` characters in all, so memory follows the largest text and not the batch."""
    begin = total = 0
    for k, n in enumerate(sizes):
        if total and total + n > most:
            yield begin, k
            begin, total = k, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)
