"""The reference: contigs, ambiguous runs, packed bases, suffix array.

The text is the forward strand followed by its reverse complement, so a position of at least ``half`` is on the reverse
strand. An index is a folder of ``.npy`` files and a JSON table, written by ``save`` and mapped into memory by ``load``.
Large genomes come with an index made elsewhere: its packed bases, and its sampled suffix array, which is filled in from the
Burrows-Wheeler transform (``read_packed``).
"""

from __future__ import annotations

import functools
import gzip
import json
import os
from dataclasses import dataclass

import numpy as np

CODE = np.full(256, 4, np.uint8)
for _i, _b in enumerate("ACGT"):
    CODE[ord(_b)] = CODE[ord(_b.lower())] = _i
LETTERS = np.frombuffer(b"ACGTN", np.uint8)


def encode(seq: str) -> np.ndarray:
    return CODE[np.frombuffer(seq.encode(), np.uint8)]


def decode(codes: np.ndarray) -> str:
    return LETTERS[codes].tobytes().decode()


def complement(codes: np.ndarray) -> np.ndarray:
    """Reversed and complemented; an ambiguous base stays one."""
    return np.where(codes < 4, 3 - codes, 4).astype(np.uint8)[::-1]


class Lcg48:
    """The 48-bit linear congruential generator of POSIX, whose high 31 bits are the numbers."""

    def __init__(self, seed: int):
        self.x = (seed << 16) + 0x330E

    def next(self) -> int:
        self.x = (self.x * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        return self.x >> 17


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By doubling: suffixes are ranked by 1, 2, 4 ... characters. The end sorts first."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    rank = text.astype(np.int64) + 1
    k = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] if k < n else second[:0]
        order, new = _ranked(rank, second, max(n, 8) + 2)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if rank.max() == n or k >= n:
            return order
        k *= 2


#: The largest number whose pairs are ranked as one number of 63 bits.
ONE_KEY = 3_000_000_000


def _ranked(first: np.ndarray, second: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of pairs of numbers below most, and which of them, in that order, differ from the one before."""
    if most <= ONE_KEY:
        key = first * most + second
        order = np.argsort(key, kind="stable")
        s = key[order]
        return order, np.concatenate([[True], s[1:] != s[:-1]])
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    return order, np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])


def packed_words(codes: np.ndarray) -> np.ndarray:
    """Codes 0 to 3 in words of 32, the first in the high bits, and two words of zeros."""
    n = -(-len(codes) // 32)
    out = np.zeros(n + 2, np.uint64)
    shift = np.arange(62, -2, -2).astype(np.uint64)
    for at in range(0, n, 1 << 16):
        part = np.zeros(min(1 << 16, n - at) * 32, np.uint64)
        own = codes[at * 32 : at * 32 + len(part)]
        part[: len(own)] = own
        out[at : at + len(part) // 32] = np.bitwise_or.reduce(part.reshape(-1, 32) << shift, axis=1)
    return out


def row_starts(words: np.ndarray, sa: np.ndarray, most: int = 12) -> np.ndarray | None:
    """Of every string of so many bases as the text is long, up to ``most``: the first row of the suffix array that isn't below it."""
    depth = min(most, (len(sa).bit_length() - 1) // 2)
    if depth < 1:
        return None
    out = np.zeros(4**depth + 1, np.int64)
    for at in range(0, len(sa), 1 << 22):
        pos = np.asarray(sa[at : at + (1 << 22)]).astype(np.int64)
        w, s = pos >> 5, ((pos & 31) << 1).astype(np.uint64)
        key = ((words[w] << s) | ((words[w + 1] >> np.uint64(1)) >> (np.uint64(63) - s))) >> np.uint64(64 - 2 * depth)
        out[1:] += np.bincount(key.astype(np.int64), minlength=4**depth)
    return np.cumsum(out)


@dataclass
class Index:
    names: list[str]
    offsets: np.ndarray
    lengths: np.ndarray
    is_alt: np.ndarray
    annos: list[str]
    holes: list[tuple[int, int, str]]
    text: np.ndarray  # forward and reverse complement, codes 0 to 3
    sa: np.ndarray
    words: np.ndarray | None = None  # the text, 32 bases a word
    starts: np.ndarray | None = None  # rows of the suffix array by the first bases

    def __post_init__(self):
        if self.words is None:
            self.words = packed_words(self.text)
            self.starts = row_starts(self.words, self.sa)

    @property
    def half(self) -> int:
        return len(self.text) // 2

    def contig_of(self, pos: int) -> int:
        """The contig of a forward position."""
        return int(np.searchsorted(self.offsets, pos, "right")) - 1

    def contig_of_span(self, begin: int, end: int) -> int:
        """The contig that holds [begin, end) of the doubled text; -1 if it bridges strands or contigs."""
        if begin < self.half < end or end <= begin:
            return -1
        a, b = self.forward(begin), self.forward(end - 1)
        x, y = self.contig_of(a), self.contig_of(b)
        return x if x == y else -1

    def forward(self, pos: int) -> int:
        return pos if pos < self.half else 2 * self.half - 1 - pos

    def ambiguous(self, begin: int, end: int) -> int:
        """Bases of the forward span that were ambiguous."""
        return sum(max(0, min(end, o + n) - max(begin, o)) for o, n, _ in self.holes)

    def fetch(self, begin: int, end: int) -> np.ndarray:
        return self.text[max(0, begin) : min(end, len(self.text))]

    def clipped(self, begin: int, mid: int, end: int) -> tuple[int, int, int]:
        """The span cut to the contig and strand that mid is in: begin, end, contig."""
        rid = self.contig_of(self.forward(mid))
        lo, hi = int(self.offsets[rid]), int(self.offsets[rid] + self.lengths[rid])
        if mid >= self.half:
            lo, hi = 2 * self.half - hi, 2 * self.half - lo
        return max(begin, lo), min(end, hi), rid

    def save(self, path: str) -> None:
        os.makedirs(path, exist_ok=True)
        np.save(f"{path}/text.npy", self.text)
        np.save(f"{path}/sa.npy", self.sa)
        np.save(f"{path}/words.npy", self.words)
        np.save(f"{path}/starts.npy", np.zeros(0, np.int64) if self.starts is None else self.starts)
        table = {"names": self.names, "offsets": self.offsets.tolist(), "lengths": self.lengths.tolist(), "is_alt": self.is_alt.tolist(), "annos": self.annos, "holes": self.holes}
        with open(f"{path}/contigs.json", "w", encoding="utf-8") as f:
            json.dump(table, f)

    def contigs(self, spark):
        rows = [(i, n, int(o), int(m), bool(a), t) for i, (n, o, m, a, t) in enumerate(zip(self.names, self.offsets, self.lengths, self.is_alt, self.annos))]
        return spark.createDataFrame(rows, "rid int, name string, offset long, len int, is_alt boolean, anno string")

    def hole_table(self, spark):
        return spark.createDataFrame([(int(o), int(n), a) for o, n, a in self.holes], "offset long, len int, amb string")


@functools.lru_cache(maxsize=2)
def load(path: str) -> Index:
    """Mapped, so that processes of one machine share the pages."""
    with open(f"{path}/contigs.json", encoding="utf-8") as f:
        t = json.load(f)
    return Index(t["names"], np.array(t["offsets"], np.int64), np.array(t["lengths"], np.int64), np.array(t["is_alt"], bool), t["annos"], [tuple(h) for h in t["holes"]], *(np.load(f"{path}/{x}.npy", mmap_mode="r") for x in ("text", "sa", "words")), _or_none(np.load(f"{path}/starts.npy")))


def _or_none(x: np.ndarray) -> np.ndarray | None:
    return x if len(x) else None


def build(contigs: list[tuple[str, str, str]], alt: set[str] = frozenset(), seed: int = 11) -> Index:
    """Of (name, annotation, sequence). Ambiguous bases become random ones, by a generator that is always seeded alike."""
    random = Lcg48(seed)
    names, annos, lengths, holes, parts = [], [], [], [], []
    at = 0
    for name, anno, seq in contigs:
        codes = encode(seq).copy()
        last = None
        for i in np.flatnonzero(codes > 3):
            letter = seq[i]
            if last == (i - 1, letter):
                o, n, _ = holes[-1]
                holes[-1] = (o, n + 1, letter)
            else:
                holes.append((at + int(i), 1, letter))
            last = (i, letter)
            codes[i] = random.next() & 3
        names.append(name)
        annos.append(anno)
        lengths.append(len(codes))
        parts.append(codes)
        at += len(codes)
    forward = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    text = np.concatenate([forward, complement(forward)]).astype(np.uint8)
    lengths = np.array(lengths, np.int64)
    return Index(names, np.cumsum(lengths) - lengths, lengths, np.array([n in alt for n in names], bool), annos, holes, text, suffix_array(text))


def read_fasta(path: str) -> list[tuple[str, str, str]]:
    with (gzip.open if path.endswith(".gz") else open)(path, "rt") as f:
        out: list[list] = []
        for line in f:
            line = line.rstrip("\n")
            if line.startswith(">"):
                name, _, anno = line[1:].partition(" ")
                out.append([name, anno, []])
            elif out:
                out[-1][2].append(line.strip())
    return [(n, a, "".join(s)) for n, a, s in out]


def read_alt(path: str) -> set[str]:
    """The names of alternative contigs: the first field of each line that isn't a header."""
    with open(path) as f:
        return {x.split("\t")[0].strip() for x in f if x.strip() and not x.startswith("@")}


def read_packed(prefix: str) -> Index:
    """From the files of an existing index: .ann, .amb, .pac, optionally .alt; with .bwt and .sa its suffix array is filled in, else
    it is built. A prefix whose files have the additional extension .64 is found by either name."""
    if not os.path.exists(f"{prefix}.ann") and os.path.exists(f"{prefix}.64.ann"):
        prefix += ".64"
    with open(f"{prefix}.ann") as f:
        total, n, _ = map(int, f.readline().split())
        names, annos, offsets, lengths = [], [], [], []
        for _ in range(n):
            _, name, *anno = f.readline().rstrip("\n").split(" ", 2)
            o, m, _ = map(int, f.readline().split())
            names.append(name)
            annos.append("" if anno in ([], ["(null)"]) else anno[0])
            offsets.append(o)
            lengths.append(m)
    with open(f"{prefix}.amb") as f:
        _, _, k = map(int, f.readline().split())
        holes = [(int(o), int(m), c) for o, m, c in (f.readline().split() for _ in range(k))]
    packed = np.fromfile(f"{prefix}.pac", np.uint8)
    forward = ((packed[:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3).ravel()[:total].astype(np.uint8)
    alt = read_alt(f"{prefix}.alt") if os.path.exists(f"{prefix}.alt") else set()
    text = np.concatenate([forward, complement(forward)]).astype(np.uint8)
    sa = read_suffix_array(prefix) if os.path.exists(f"{prefix}.bwt") and os.path.exists(f"{prefix}.sa") else suffix_array(text)
    return Index(names, np.array(offsets, np.int64), np.array(lengths, np.int64), np.array([x in alt for x in names], bool), annos, holes, text, sa)


#: Fixed values of the files: symbols between counters, and words of 16 symbols and of counters in such a block.
BLOCK, BLOCK_WORDS, COUNTER_WORDS = 128, 8, 8


def read_transform(path: str) -> tuple[int, np.ndarray]:
    """The row of the whole text, and the symbols of the transform without its end, from a .bwt file (counters are passed over)."""
    head = np.fromfile(path, "<u8", 5)
    primary, n = int(head[0]), int(head[4])
    words = np.memmap(path, "<u4", "r", offset=40)
    out = np.empty(n, np.uint8)
    shift = np.arange(30, -2, -2).astype(np.uint32)
    step = BLOCK_WORDS + COUNTER_WORDS
    for at in range(0, n, BLOCK << 12):
        m = min(n - at, BLOCK << 12)
        part = np.asarray(words[at // BLOCK * step : -(-(at + m) // BLOCK) * step])
        part = np.concatenate([part, np.zeros(-len(part) % step, np.uint32)]).reshape(-1, step)[:, COUNTER_WORDS:].ravel()
        out[at : at + m] = ((part[:, None] >> shift) & 3).ravel()[:m]
    return primary, out


def read_suffix_array(prefix: str) -> np.ndarray:
    """The whole suffix array, from every so many-th row that the .sa file holds: the other rows step to the suffix that begins one
    base earlier until they meet a row that is known."""
    primary, symbols = read_transform(f"{prefix}.bwt")
    n = len(symbols)
    head = np.fromfile(f"{prefix}.sa", "<u8", 7)
    every = int(head[5])
    if int(head[0]) != primary or int(head[6]) != n:
        raise ValueError(f"{prefix}.sa and {prefix}.bwt are of different texts")
    known = np.fromfile(f"{prefix}.sa", "<u8", offset=56).astype(np.int64)
    out = np.full(n + 1, -1, np.int64)
    out[0] = n
    rows = np.arange(every, n + 1, every)
    out[rows] = known[: len(rows)]
    # the row of the suffix one base longer, of each row: how many symbols are smaller, and equal ones before
    earlier = np.empty(n + 1, np.int64)
    place = np.delete(np.arange(n + 1), primary)
    below = 1
    for c in range(4):
        own = place[symbols == c]
        earlier[own] = np.arange(below, below + len(own))
        below += len(own)
    earlier[primary] = 0
    open_ = np.flatnonzero(out < 0)
    at, steps = open_.copy(), 0
    found = np.empty(len(open_), np.int64)
    left = np.arange(len(open_))
    while len(left):
        steps += 1
        at = earlier[at]
        value = out[at]
        met = value >= 0
        # row 0 is the end, which stands before the text's first base
        found[left[met]] = np.where(at[met] == 0, -1, value[met]) + steps
        left, at = left[~met], at[~met]
    out[open_] = found
    return out[1:]
