"""LM scoring by logistic context mixing.

A text is its words, A-Z in lower case, and an end. A word is spelled as its bytes and a space, the end as a line feed;
a byte is a path of binary decisions in a prefix code. Each decision is predicted in hashed contexts: the word so far with the
text's kind, and the last two (with the kind), three and five bytes. These go on across the space: the first byte of a word
sees the last two letters of the word before, the second byte the last one. The kind is what the words before tell (clusters of
texts, in effect languages), so it adapts along the text. A context's slot holds how often either side was taken in the
corpus; what such a history tells is learned too. The predictions are combined by a logistic mixer, whose weight set is
gated by how often the word so far was seen and by the place in the word, and the result is refined by an adaptive map from
(mixed prediction, last byte) to what came true.

Beyond the word, a text is cut in stretches: one begins wherever the hash of the two words before is 0 modulo STRIDE. One
more decision, made at its start, is whether the stretch is one that training saw after the same two words, in another
text: its odds are those that training gives contexts seen so often, moved by how often the text's last stretches were
known. With chance l for known, a stretch seen c of T times after its context has l * c / T + (1 - l) * (its spelling).
So word order, phrases and copies count. A training text's own stretches are taken off the counts before it is scored.

Passes, each where the rows are: bytes and kinds; learning, online along all training texts: a task's texts are predicted
with what it has counted so far, weights, map and what histories tell are moved, and then the texts are counted; spelling of
all texts, whose words and stretches go to slabs by hash, are counted there, and come back by block of texts. No text is left
out. Tasks' tables are added up, their weights averaged over all steps; nothing but such tables of fixed size passes the
driver. Tables have one slot for every 4 bytes of training text, up to 2^TABLE_BITS; beyond that contexts share slots.

Defined results: a null or empty text is the end alone; without training texts N and V are 0, and all decisions are even;
whole texts are scored at any length; repeated rows are scored alike; a row without id counts as training; an empty
table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import functools
import heapq
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import bounded_batches, crc_mod, removed, stored, table, text_slices, tidied, word_codes

#: Slots at most, by context; the least; slots of a slab; tables added at a time.
TABLE_BITS, LEAST_BITS, SLAB_BITS, FAN = (23, 20, 21, 22), 18, 18, 32
CONTEXTS, STATES, GATES = 4, 10, 72
#: Words of the text's kind are told apart by a hash of so many bits, and are at most so long.
KIND_BITS, KIND_LENGTH = 10, 4
#: One place in so many begins a stretch; stretches of the text that its odds look back on.
STRIDE, LOOK_BACK = 16, 16
#: Classes of how often a stretch's context was seen.
CLASSES = 24
SLAB_BYTES = 32 << 20
#: Bytes of text in a batch, and rows; a task learns from batches that grow up to that.
BATCH, FIRST_BATCH, ROWS = 7 << 20, 8 << 10, 1500
END, SPACE, LINE = b"\n", 32, 10
BUCKETS, FINE = 33, 32
#: Steps of a task after which its weights count in the average, and the map follows them.
SETTLED = 30

_mult = np.random.default_rng(4).integers(0, 2**63, 24, dtype=np.uint64) | np.uint64(1)


def prefix_code(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each byte: length of its code, and by place the node and the side taken."""
    heap = [(int(w) + 1, b, b) for b, w in enumerate(weights)]
    heapq.heapify(heap)
    child: dict[int, tuple] = {}
    new = 256
    while len(heap) > 1:
        (w, _, a), (v, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        child[new] = a, b
        heapq.heappush(heap, (w + v, new, new))
        new += 1
    paths: list[list] = [[] for _ in range(256)]
    todo = [(heap[0][2], [])]
    while todo:
        n, path = todo.pop()
        if n < 256:
            paths[n] = path
        else:
            todo += [(c, [*path, (n - 256, side)]) for side, c in enumerate(child[n])]
    length = np.array([len(p) for p in paths], np.int64)
    node, side = np.zeros((256, length.max()), np.uint64), np.zeros((256, length.max()), np.uint8)
    for b, p in enumerate(paths):
        for i, (n, s) in enumerate(p):
            node[b, i], side[b, i] = n, s
    return length, node, side


def _clustered(x: np.ndarray, kinds: int = STATES - 1) -> np.ndarray:
    """Rows of word counts added up to at most ``kinds`` clusters (k-means on the unit sphere, of root counts; a row weighs as many
    words as it has)."""
    x = x[x.any(axis=1)]
    weight = x.sum(axis=1)
    unit = np.sqrt(x)
    unit /= np.sqrt(weight)[:, None]
    # each next centre is a heavy row far from those before
    chosen = [int(weight.argmax())] if len(x) else []
    while chosen and len(chosen) < min(kinds, len(x)):
        chosen.append(int(((1 - (unit @ unit[chosen].T).max(axis=1)) ** 2 * weight).argmax()))
    centre = unit[chosen]
    own = np.zeros(len(x), np.int64)
    for _ in range(6 if chosen else 0):
        own = (unit @ centre.T).argmax(axis=1)
        for k in range(len(chosen)):
            if (own == k).any():
                centre[k] = weight[own == k] @ unit[own == k]
        centre = centre / np.maximum(1e-6, np.sqrt((centre * centre).sum(axis=1, keepdims=True)))
    return np.stack([x[own == k].sum(axis=0) for k in range(len(chosen)) if (own == k).any()]) if chosen else np.zeros((0, x.shape[1]), np.float32)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = SPACE


def _short(flat: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Of words of at most KIND_LENGTH bytes that stand in flat: the column that they count in."""
    word = np.zeros(len(at), np.uint32)
    for i in range(KIND_LENGTH):
        byte = flat[np.minimum(at + i, len(flat) - 1)].astype(np.uint32)
        word = np.where(length > i, word << np.uint32(8) | byte, word)
    return ((word * np.uint32(2654435761)) >> np.uint32(32 - KIND_BITS)).astype(np.int64)


def _kind_words(batch: Batch) -> np.ndarray:
    """Of each word, the column that it counts in, or -1."""
    flat, at, length, _ = batch.flat
    out = np.full(len(at), -1)
    some = np.flatnonzero((length <= KIND_LENGTH) & (np.arange(len(at)) > 0))
    out[some] = _short(flat, at[some], length[some])
    return out


def kind_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How often each byte is spelled in texts, about: letters in lower case, white space as one space, and an end each; and the
    short words of each text, by column."""
    rows = texts.cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"").to_pylist()
    flat = np.frombuffer(b" ".join([b"", *rows, b""]).translate(_LOWER.tobytes()), np.uint8)
    # in parts: each is widened to be counted
    n = sum(np.bincount(flat[a : a + (1 << 16)], minlength=256) for a in range(0, len(flat), 1 << 16)).astype(np.int64)
    n[LINE] = len(texts)
    spaces = np.flatnonzero(flat == SPACE)
    length = np.diff(spaces) - 1
    short = np.flatnonzero((length > 0) & (length <= KIND_LENGTH))
    at = spaces[short] + 1
    row = np.searchsorted(np.cumsum([len(r) + 1 for r in rows]), at, "right")
    column = _short(flat, at, length[short])
    return n, np.bincount(row << KIND_BITS | column, minlength=len(texts) << KIND_BITS).reshape(len(texts), -1).astype(np.float32)


class Topics:
    """What short words tell of a text's kind (in effect, its language): log probabilities by kind."""

    def __init__(self, counts: np.ndarray | None = None):
        counts = np.zeros((0, 1 << KIND_BITS), np.float32) if counts is None else counts
        # in the order of their size, so that the same texts give the same kinds however they were dealt out
        counts = counts[np.lexsort((counts.argmax(axis=1), -counts.sum(axis=1)))]
        total = counts.sum(axis=1, keepdims=True)
        self.told = np.log((counts + 0.5) / (total + 0.5 * counts.shape[1])).T.astype(np.float64)
        if len(counts):
            self.told -= self.told.max(axis=1, keepdims=True)
            self.told[counts.sum(axis=0) == 0] = 0

    def states(self, batch: Batch) -> np.ndarray:
        """Of each token: 0, or 1 + the kind that the words before it in its text tell."""
        if not len(batch.token) or not self.told.shape[1]:
            return np.zeros(len(batch.token), np.int64)
        column = _kind_words(batch)
        known = (column >= 0)[batch.token]
        at = np.flatnonzero(known)
        before = np.concatenate([[0], np.cumsum(known)])
        first = before[batch.start]
        origin, told_by = first[np.searchsorted(batch.start, at, "right") - 1], column[batch.token[at]]
        after = np.zeros(len(at) + 1, np.int64)
        most = np.full(len(at), -np.inf)
        for k in range(self.told.shape[1]):
            # what each of the words that tell has told together with those before it in its text
            upto = np.concatenate([[0.0], np.cumsum(np.take(self.told[:, k], told_by, mode="clip"))])
            own = upto[1:] - np.take(upto, origin, mode="clip")
            after[1:][own > most] = k + 1
            np.maximum(most, own, out=most)
        # a token sees the last word that tells before it, if that is one of its text
        state = after[before[:-1]]
        state[before[:-1] == np.repeat(first, batch.size)] = 0
        return state


class Batch:
    """Texts as tokens, and the edges that spell them.

    An edge is a byte in the contexts that it is predicted in; all its decisions depend on that alone, so they are made once.
    A word's first byte depends on the kind and the last two letters before (edges a), its second on the kind, the last
    letter before and the first byte (edges b), and the others on the kind and the word so far (edges c): words of one kind share
    the edges of a common beginning. A unit is a word in a kind."""

    def __init__(self, texts, topics: Topics | None):
        """texts: strings or nulls, as a list or an Arrow array."""
        self.known, index, sizes = word_codes(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts)
        self.size = sizes + 1
        self.start = np.cumsum(self.size) - self.size
        self.token = np.zeros(int(self.size.sum()), np.int32)  # the end is word 0
        self.token[np.arange(len(index)) + np.repeat(np.arange(len(sizes)), sizes)] = index + 1
        if topics is not None:
            self.spell(topics.states(self))

    @functools.cached_property
    def words(self) -> list[bytes]:
        return [END, *self.known.to_pylist()]

    @functools.cached_property
    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The words' bytes with a space after each, where each word begins and how long it is, and hashes of their beginnings."""
        # out of Arrow's buffers: an object for each word would cost more than all else here
        length = np.append(len(END), pc.binary_length(self.known).to_numpy(zero_copy_only=False).astype(np.int64))
        at = np.cumsum(length + 1) - length - 1
        flat = np.full(int(length.sum()) + len(length), SPACE, np.uint8)
        letter = np.ones(len(flat), bool)
        letter[at + length] = False
        flat[letter] = np.frombuffer(END + b"".join(_contents(self.known)), np.uint8)
        return flat, at, length, _beginnings(flat, at, length)

    @functools.cached_property
    def hash(self) -> np.ndarray:
        """Of each word: of its beginning up to its end, mixed once more."""
        _, at, length, so_far = self.flat
        h = (so_far[at + length - 1] ^ (length.astype(np.uint64) << np.uint64(48))) * _mult[23]
        return h ^ (h >> np.uint64(32))

    def spell(self, state: np.ndarray) -> None:
        flat, at, length, so_far = self.flat
        first, second = flat[at].astype(np.int64), flat[np.minimum(at + 1, len(flat) - 1)].astype(np.int64)
        last, last2 = flat[at + length - 1].astype(np.int64), np.where(length > 1, flat[at + np.maximum(length, 2) - 2], SPACE).astype(np.int64)
        token = self.token
        tail = (last2 << 8 | last)[token]
        before = np.empty(len(token), np.int64)
        before[1:] = tail[:-1]
        before[self.start] = LINE << 8 | LINE
        self.a, a = pd.factorize(state << 24 | before << 8 | first[token])
        inner = np.flatnonzero(token)
        self.b = np.full(len(token), -1)
        self.b[inner], b = pd.factorize((state << 24 | (before & 255) << 16)[inner] | (first << 8 | second)[token[inner]])
        self.unit, units = pd.factorize(token.astype(np.int64) << 4 | state)
        times = np.bincount(self.unit, minlength=len(units))
        # edges c: of the units' bytes from the third on, those of different beginnings
        word, kind = units >> 4, (units & 15).astype(np.uint64)
        n = np.maximum(0, length[word] - 1) * (word > 0)
        self.owner = np.repeat(np.arange(len(units), dtype=np.int32), n)
        place = np.arange(len(self.owner), dtype=np.int32) - np.repeat((np.cumsum(n) - n - 2).astype(np.int32), n)
        where = at.astype(np.int32)[word][self.owner] + place
        self.c, fresh = _first_of((so_far[where] + kind[self.owner] * _mult[18]) * _mult[19])
        where, place, kind = where[fresh], place[fresh], kind[self.owner[fresh]]
        # the bytes before, nine bits each from 1 on, the last one first; the space before the word where a context reaches it
        before_c = np.zeros(len(where), np.uint64)
        for k in range(1, 6):
            byte = flat[np.maximum(0, where - k)].astype(np.uint64) + np.uint64(1)
            if k > 2:
                byte[place < k] = 0
                byte[place == k - 1] = SPACE + 1
            before_c = before_c << np.uint64(9) | byte
        one = np.uint64(1)
        ua, ub = a.astype(np.uint64), b.astype(np.uint64)
        byte_of = lambda x, shift: (x >> np.uint64(shift)) & np.uint64(255)
        packed = lambda *x: functools.reduce(lambda y, z: y << np.uint64(9) | z + one, x, np.zeros(len(x[0]), np.uint64)) << np.uint64(18)
        space_a, space_b = (np.where(x == LINE, np.uint64(LINE), np.uint64(SPACE)) for x in (byte_of(ua, 8), byte_of(ub, 16)))
        before_a = packed(space_a, byte_of(ua, 8), byte_of(ua, 16))
        before_b = packed(byte_of(ub, 8), space_b, byte_of(ub, 16))
        self.previous = np.concatenate([before_a, before_b, before_c])
        none_a = np.zeros(len(a), np.uint64)
        self.head = np.concatenate([none_a + _mult[20], byte_of(ub, 8) * _mult[21] + _mult[22], so_far[where - 1]])
        self.kind = np.concatenate([ua >> np.uint64(24), ub >> np.uint64(24), kind])
        self.place = np.concatenate([np.zeros(len(a), np.int32), np.ones(len(b), np.int32), np.full(len(where), 2, np.int32)])
        self.byte = np.concatenate([byte_of(ua, 0), byte_of(ub, 0), flat[where].astype(np.uint64)]).astype(np.uint8)
        self.n_a, self.n_b = len(a), len(b)
        self.times = np.concatenate([np.bincount(self.a, minlength=len(a)), np.bincount(self.b[inner], minlength=len(b)), np.bincount(self.c, times[self.owner], len(where))]).astype(np.uint32)

    def of_tokens(self, edge: np.ndarray) -> np.ndarray:
        """Of each token, the sum of what its edges have."""
        rest = np.bincount(self.owner, edge[self.n_a + self.n_b :][self.c], int(self.unit.max(initial=-1)) + 1)
        return edge[self.a] + np.append(edge[self.n_a : self.n_a + self.n_b], 0.0)[self.b] + rest[self.unit]

    def counts(self) -> np.ndarray:
        return np.bincount(self.token, minlength=len(self.known) + 1)

    def chunks(self, most: int = 6_000) -> Iterator[slice]:
        for a in range(0, len(self.byte), most):
            yield slice(a, min(a + most, len(self.byte)))

    def mixed(self, most: int = 6_000) -> Iterator[np.ndarray]:
        """Chunks of edges in an order that has common and rare ones everywhere."""
        order = np.random.default_rng(len(self.byte)).permutation(len(self.byte))
        for a in range(0, len(order), most):
            yield order[a : a + most]


def _contents(words: pa.Array) -> list[pa.Buffer]:
    """The buffer that has the bytes of all words of a large binary array, one after the other; none for no words."""
    if not len(words):
        return []
    _, offsets, data = words.buffers()
    first, last = np.frombuffer(offsets, np.int64)[[words.offset, words.offset + len(words)]].tolist()
    return [data.slice(first, last - first)]


def _beginnings(flat: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Of each byte of words that stand in flat, each with a space after it: a hash of its word up to and with it."""
    place = np.arange(len(flat)) - np.repeat(at, length + 1)
    wide = flat.astype(np.uint64) + np.uint64(1)
    power = np.cumprod(np.full(int(place.max(initial=0)) + 1, _mult[0], np.uint64), dtype=np.uint64)
    total = np.cumsum((wide * _mult[1] ^ (wide << np.uint64(17))) * power[place], dtype=np.uint64)
    before = np.where(at > 0, total[at - 1], np.uint64(0))
    head = total - np.repeat(before, length + 1) + place.astype(np.uint64)
    head ^= head >> np.uint64(29)
    head *= _mult[2]
    return head


def _first_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of keys in the order of their first places, and those places."""
    code, keys = pd.factorize(key)
    code, n = code.astype(np.int32), len(keys)
    del keys
    fresh = np.empty(n, np.int32)
    fresh[code[::-1]] = np.arange(len(key), dtype=np.int32)[::-1]
    return code, fresh


class Coder:
    """Decisions of a batch's edges, and the slots of their contexts."""

    def __init__(self, weights: np.ndarray, topics: Topics, bits: tuple[int, ...] = TABLE_BITS):
        self.length, self.node, self.side = prefix_code(weights)
        self.topics, self.bits = topics, bits
        self.salt = ((self.node + np.uint64(1)) * _mult[6]).ravel()

    def decisions(self, batch: Batch, some: slice | np.ndarray):
        """Of some edges: side, slots (contexts x decisions), gate place, last byte, edge of each decision (its place in some)."""
        five, kind, byte = batch.previous[some], batch.kind[some], batch.byte[some]
        two, three = five >> np.uint64(27), five >> np.uint64(18)
        contexts = (batch.head[some] + (kind << np.uint64(58)) * _mult[8], (two + (kind << np.uint64(40))) * _mult[3], (three + np.uint64(1)) * _mult[4], (five + np.uint64(2)) * _mult[5])
        reps = self.length[byte]
        at = np.repeat(np.arange(len(byte), dtype=np.int32), reps)
        # the place in the code's table: the byte's row, from its start on
        cell = np.arange(len(at), dtype=np.int32) - np.repeat((np.cumsum(reps) - reps - byte.astype(np.int64) * self.node.shape[1]).astype(np.int32), reps)
        salt = np.take(self.salt, cell, mode="clip")
        slots = []
        for c, bits in zip(contexts, self.bits):
            h = np.take(c, at, mode="clip")
            h ^= salt
            h *= _mult[7]
            h >>= np.uint64(64 - bits)
            slots.append(h.view(np.int64))
        return np.take(self.side.ravel(), cell, mode="clip"), slots, np.take(batch.place[some], at, mode="clip"), np.take((five >> np.uint64(36)).astype(np.int32) - 1, at, mode="clip"), at


#: A count as a small number: exact below 32, then in sixteen steps an octave, as the head of a float.
CODES = 16 * 33
FEW, ODDS = 20, 280
HISTORIES = FEW * FEW + 3 * (2 * ODDS + 1)


def _coded(n: np.ndarray) -> np.ndarray:
    x = n.astype(np.float32).view(np.int32)
    x >>= 19
    x -= (127 << 4) - 1
    return np.maximum(x, 0, out=x)


def _value(code: np.ndarray) -> np.ndarray:
    """The least count of a code."""
    bits = ((code.astype(np.int64) + (127 << 4) - 1) << 19).astype(np.uint32)
    return np.where(code > 0, bits.view(np.float32).astype(np.float64), 0.0)


def _history_table() -> np.ndarray:
    """A slot's history as a small number, by the codes of its counts: both counts while they are few, else their odds in steps
    of 1/24 and three classes of size."""
    n0, n1 = (_value(x) for x in np.divmod(np.arange(CODES * CODES), CODES))
    odds = np.clip(np.round(24 * np.log((n1 + 0.4) / (n0 + 0.4))), -ODDS, ODDS)
    size = np.clip(np.floor(np.log10(n0 + n1 + 1)) - 1, 0, 2)
    few = (n0 < FEW) & (n1 < FEW)
    return np.where(few, np.floor(n0) * FEW + np.floor(n1), FEW * FEW + size * (2 * ODDS + 1) + odds + ODDS).astype(np.uint16)


_HISTORY = _history_table()


def history(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.take(_HISTORY, _coded(n0) * np.int32(CODES) + _coded(n1))


def _typical() -> tuple[np.ndarray, np.ndarray]:
    """Of each history: a first guess at the log odds, and the class for the gate: size, and whether one side only was seen."""
    few = np.arange(FEW * FEW)
    n0, n1 = few // FEW, few % FEW
    odds = np.concatenate([np.log((n1 + 0.4) / (n0 + 0.4)), np.tile(np.arange(-ODDS, ODDS + 1) / 24, 3)])
    size = np.concatenate([np.minimum(5, np.log2(n0 + n1 + 1)).astype(np.int64), np.repeat([5, 6, 7], 2 * ODDS + 1)])
    sure = np.concatenate([(n0 == 0) | (n1 == 0), np.abs(np.tile(np.arange(-ODDS, ODDS + 1), 3)) > 150])
    return odds, size + 8 * sure


class Model:
    """What histories tell, gated weights and the adaptive map; and the tables, counts while learning and histories when done."""

    def __init__(self, coder: Coder):
        self.coder = coder
        odds, self.kind = _typical()
        self.told_hits = np.repeat(2 / (1 + np.exp(-odds))[None, :], CONTEXTS, axis=0)
        self.told_tries = np.full((CONTEXTS, HISTORIES), 2.0)
        self.weights = np.full((GATES, CONTEXTS + 1), 0.35, np.float32)
        self.weights[:, CONTEXTS] = 0
        self.hits = np.repeat(1 / (1 + np.exp(-(np.arange(BUCKETS) - BUCKETS // 2) / 2.0))[None, :], 256, axis=0) * 6
        self.tries = np.full((256, BUCKETS), 6.0)
        self.square, self.average, self.done = np.zeros((GATES, CONTEXTS + 1)), np.zeros((GATES, CONTEXTS + 1)), 0
        self.slots: list[np.ndarray] = []
        self.settle()

    def settle(self) -> None:
        """What histories tell; the map, and from it the cost of either side by last byte and mixed prediction (in steps of 1 / FINE)."""
        self.tell()
        self.map = (self.hits / self.tries).astype(np.float32)
        t = (np.arange(24 * FINE) + 0.5) / FINE - 12
        low, part = self.bucket(t)
        refined = self.map[:, low] * (1 - part) + self.map[:, low + 1] * part
        p = np.clip(0.5 / (1 + np.exp(-t)) + 0.5 * refined, 1e-5, 1 - 1e-5)
        self.cost = np.log10(np.stack([1 - p, p])).astype(np.float32).ravel()

    def tell(self) -> None:
        p = np.clip(self.told_hits / self.told_tries, 1e-5, 1 - 1e-5)
        self.told = np.log(p / (1 - p)).astype(np.float32)

    def inputs(self, seen, place):
        """What histories tell (a row each, and a constant), and the gate."""
        x = np.empty((CONTEXTS + 1, len(place)), np.float32)
        for k in range(CONTEXTS):
            np.take(self.told[k], seen[k], out=x[k], mode="clip")
        x[CONTEXTS] = 0.3
        # where the word so far is new, how often its last five bytes were seen
        gate = np.take((self.kind * 3).astype(np.int32), seen[0], mode="clip")
        new = np.flatnonzero(seen[0] == 0)
        gate[new] = (16 + (self.kind[seen[3][new]] & 7)) * 3
        gate += place
        return x, gate

    def mixed(self, x, gate):
        columns = np.ascontiguousarray(self.weights.T)
        t = np.zeros(x.shape[1], np.float32)
        for k in range(CONTEXTS + 1):
            part = np.take(columns[k], gate, mode="clip")
            part *= x[k]
            t += part
        return np.clip(t, -12, 12, out=t)

    @staticmethod
    def bucket(t):
        s = np.clip(t * 2 + BUCKETS // 2, 0, BUCKETS - 1.001)
        low = s.astype(np.int64)
        return low, s - low

    def learn(self, batch: Batch, step: int = 16384, rate: float = 0.03) -> None:
        """Online: a batch is predicted from the counts of those before it; weights, map and what histories tell move with each step;
        then it is counted. The map follows the mixer once that has settled."""
        self.slots = self.slots or [np.zeros(2 << bits, np.uint32) for bits in self.coder.bits]
        counted = []
        for some in batch.mixed():
            side, slots, place, last, at = self.coder.decisions(batch, some)
            times = batch.times[some][at]
            seen = []
            for k in range(CONTEXTS):
                # both counts in one look
                both = _coded(np.take(self.slots[k].view(np.uint64), slots[k], mode="clip").view(np.uint32)).reshape(-1, 2)
                seen.append(np.take(_HISTORY, both[:, 0] * np.int32(CODES) + both[:, 1]))
            x, gate = self.inputs(seen, place)
            weight, wide = times.astype(np.float32), times.astype(np.float64)
            for k in range(CONTEXTS):
                both = np.bincount(seen[k].astype(np.int32) << 1 | side, wide, 2 * HISTORIES).reshape(-1, 2)
                self.told_hits[k] += both[:, 1]
                self.told_tries[k] += both[:, 0] + both[:, 1]
            for s in range(0, len(side), step):
                e = slice(s, s + step)
                t = self.mixed(x[:, e], gate[e])
                error = (side[e] - 1 / (1 + np.exp(-t))) * weight[e]
                norm = np.bincount(gate[e], wide[e], GATES) + 16
                self.done += 1
                for k in range(CONTEXTS + 1):
                    # steps scaled by the root of the mean square of the gradient, and growing shorter
                    g = np.bincount(gate[e], error * x[k, e], GATES) / norm
                    self.square[:, k] = 0.97 * self.square[:, k] + 0.03 * g * g
                    self.weights[:, k] += (rate / np.sqrt(1 + self.done / 100) * g / (np.sqrt(self.square[:, k]) + 1e-4)).astype(np.float32)
                if self.done > SETTLED:
                    self.average += self.weights
                    low, part = self.bucket(t)
                    cell = (last[e] * BUCKETS + low + (part > 0.5)) << 1 | side[e]
                    both = np.bincount(cell, wide[e], 512 * BUCKETS).reshape(256, BUCKETS, 2)
                    self.hits += both[:, :, 1]
                    self.tries += both[:, :, 0] + both[:, :, 1]
            counted.append(([(x << 1 | side).astype(np.int32) for x in slots], times))
        for slots, times in counted:
            for k in range(CONTEXTS):
                np.add.at(self.slots[k], slots[k], times)
        self.tell()

    def edge_scores(self, batch: Batch) -> np.ndarray:
        """log10 probability of each edge's byte."""
        out = np.zeros(len(batch.byte))
        for some in batch.chunks():
            side, slots, place, last, at = self.coder.decisions(batch, some)
            t = self.mixed(*self.inputs([np.take(self.slots[k], slots[k], mode="clip") for k in range(CONTEXTS)], place))
            t += np.float32(12)
            t *= np.float32(FINE)
            cell = t.astype(np.int32)
            np.minimum(cell, 24 * FINE - 1, out=cell)
            cell += (side.astype(np.int32) * 256 + last) * (24 * FINE)
            out[some] = np.bincount(at, np.take(self.cost, cell, mode="clip"), some.stop - some.start)
        return out


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpack(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def _pack_rising(x: np.ndarray) -> bytes:
    """Numbers that rise in runs: their differences (a fall wraps around), byte by byte: the first byte of all, then the second of all."""
    return _pack(np.diff(x, prepend=x.dtype.type(0)).view(np.uint8).reshape(-1, x.itemsize).T)


def _unpack_rising(x: bytes, kind) -> np.ndarray:
    planes = _unpack(x, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


def added(blocks: DataFrame, add: Callable[[list[bytes]], bytes]) -> DataFrame:
    """One row for each n of blocks (n, part, block): its blocks added up, FAN at a time."""

    def merge(t: pa.Table) -> pa.Table:
        return pa.table({"n": t["n"][:1], "part": pa.array([t["part"][0].as_py() // FAN], pa.int64()), "block": pa.array([add(t["block"].to_pylist())], pa.binary())})

    most = (blocks.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        blocks = blocks.groupBy("n", F.floor(F.col("part") / FAN).alias("_to")).applyInArrow(merge, "n bigint, part bigint, block binary")
        most = -(-most // FAN)
        if most <= 1:
            return blocks.select("n", "block")


def _row(n: int, block: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([block], pa.binary())], names=["n", "block"])


def _numbered(rows: DataFrame) -> DataFrame:
    return stored(rows.withColumn("part", F.spark_partition_id().cast("long")))


def kinds(train: DataFrame) -> tuple[np.ndarray, Topics]:
    """How often each byte stands in the training texts, and their kinds: clusters of each slice of texts, clustered again."""

    def run(batches):
        total, held = np.zeros(256, np.int64), np.zeros((0, 1 << KIND_BITS), np.float32)
        for b in batches:
            for _, texts in text_slices(b.column(0), BATCH):
                n, words = kind_counts(texts)
                total += n
                held = _clustered(np.vstack([held, words]))
        if total.any():
            yield _row(0, pickle.dumps((total, held)))

    def add(blocks):
        each = [pickle.loads(x) for x in blocks]
        x = np.vstack([h for _, h in each])
        return pickle.dumps((sum(t for t, _ in each), _clustered(x)))

    found = added(_numbered(train.select("_text").mapInArrow(tidied(run), "n bigint, block binary")), add).first()
    if found is None:
        return np.zeros(256, np.int64), Topics()
    weights, counts = pickle.loads(found["block"])
    return weights, Topics(counts)


def growing(texts: pa.Array, first: int) -> Iterator[pa.Array]:
    """Slices of texts, each of twice the bytes of the one before, from ``first`` up to BATCH."""
    size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False) + 1)
    at, most = 0, first
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield texts.slice(at, to - at)
        at, most = to, min(BATCH, 2 * most)


WHAT_IS_LEARNED = ("average", "told_hits", "told_tries", "hits", "tries")
PARAMETERS = 1 << 30


def learning(train: DataFrame, coder: Coder) -> DataFrame:
    """Rows (context and slab; packed counts) of tasks' tables, and a row (PARAMETERS; what the task learned)."""

    def run(batches):
        m, held = Model(coder), FIRST_BATCH
        for b in batches:
            for texts in growing(b.column(0), held):
                m.learn(Batch(texts, coder.topics))
                held = min(BATCH, 2 * held)
        if m.done:
            fresh = Model(coder)
            yield _row(PARAMETERS, pickle.dumps((max(0, m.done - SETTLED), *(getattr(m, x) - getattr(fresh, x) for x in WHAT_IS_LEARNED))))
            for k in range(CONTEXTS):
                for s in range(1 << coder.bits[k] - SLAB_BITS):
                    part = m.slots[k][s << SLAB_BITS + 1 : (s + 1) << SLAB_BITS + 1]
                    if part.any():
                        yield _row(k << 16 | s, _pack(part))

    return train.select("_text").mapInArrow(tidied(run), "n bigint, block binary")


def _sum_learned(blocks: list[bytes]) -> bytes:
    if len(blocks[0]) and blocks[0][:1] == b"\x80":
        return pickle.dumps(tuple(sum(x) for x in zip(*map(pickle.loads, blocks))))
    total = np.zeros(2 << SLAB_BITS, np.uint64)
    for x in blocks:
        total += _unpack(x, np.uint32)
    return _pack(np.minimum(total, 2**32 - 1).astype(np.uint32))


def digested(rows: DataFrame, model: Model) -> None:
    """Puts what all tasks learned, and the history of each slot, into the model."""
    model.slots = [np.zeros(1 << b, np.uint16) for b in model.coder.bits]

    def digest(batches):
        for b in batches:
            for n, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if n != PARAMETERS:
                    c = _unpack(x, np.uint32).reshape(-1, 2)
                    x = _pack(history(c[:, 0], c[:, 1]))
                yield _row(n, x)

    for r in rows.mapInArrow(digest, "n bigint, block binary").toLocalIterator():
        if r.n == PARAMETERS:
            steps, *rest = pickle.loads(r.block)
            for name, x in zip(WHAT_IS_LEARNED, rest):
                setattr(model, name, getattr(model, name) + x)
            if steps:
                model.weights = (model.average / steps).astype(np.float32)
        else:
            k, s = r.n >> 16, r.n & 0xFFFF
            model.slots[k][s << SLAB_BITS : (s + 1) << SLAB_BITS] = _unpack(r.block, np.uint16)
    model.settle()


# -- words and stretches: counted in slabs, scored by block -------------------------------------------------------------


def stretches(batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each stretch: first token, one past its last, hash of the two words before it, hash of itself."""
    h, n = batch.hash[batch.token], len(batch.token)
    first = np.repeat(batch.start, batch.size)
    place = np.arange(n) - first
    context = np.zeros(n, np.uint64)
    context[2:] = (h[:-2] * _mult[9] ^ (h[1:-1] >> np.uint64(7))) * _mult[10] + h[1:-1] * _mult[11]
    context ^= context >> np.uint64(31)
    context *= _mult[12]
    begin = np.flatnonzero((place >= 2) & ((context >> np.uint64(40)) % np.uint64(STRIDE) == 0))
    end = np.minimum(np.append(begin[1:], n)[: len(begin)], (batch.start + batch.size)[np.searchsorted(batch.start, begin, "right") - 1]) if len(begin) else begin
    # a running sum of tokens' hashes times powers of an odd number; taken from the stretch's start by a division by its power
    power = np.cumprod(np.full(max(1, n), _mult[13], np.uint64), dtype=np.uint64)
    total = np.concatenate([[np.uint64(0)], np.cumsum((h ^ (h >> np.uint64(29))) * _mult[14] * power, dtype=np.uint64)])
    inverse = np.uint64(pow(int(_mult[13]), -1, 1 << 64))
    back = np.cumprod(np.full(max(1, n), inverse, np.uint64), dtype=np.uint64)
    own = (total[end] - total[begin]) * back[begin] + (end - begin).astype(np.uint64) * _mult[15]
    own ^= own >> np.uint64(30)
    return begin, end, context[begin], own * _mult[16]


def _slab_cuts(h: np.ndarray, slabs: int) -> np.ndarray:
    """Where sorted hashes pass from one slab to the next: slab s is from cuts[s] to cuts[s + 1]."""
    return np.concatenate([[0], np.searchsorted(h >> np.uint64(32), np.arange(1, slabs).astype(np.uint64) * np.uint64(2**32 // slabs)), [len(h)]])


BLOCKS = "block bigint, kind int, slab int, payload binary"
WORDS, STRETCHES, TEXTS, STATISTICS = 0, 1, 2, 3


def _blocks(block: int, kind: int, slabs: list[int], payloads: list[bytes]) -> pa.RecordBatch:
    n = len(slabs)
    return pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array(slabs, pa.int32()), pa.array(payloads, pa.binary())], names=["block", "kind", "slab", "payload"])


def spelling(d: DataFrame, model, slabs: int) -> DataFrame:
    """BLOCKS of texts (id, held_out, _text): their words and stretches by slab, and what is needed to put the answers together."""

    def run(batches):
        number = TaskContext.get().partitionId() << 24
        for b in batches:
            for at, texts in text_slices(b.column(2), BATCH):
                n = len(texts)
                held = b.column(1).slice(at, n)
                train = ~held.to_numpy(zero_copy_only=False).astype(bool)
                one = Batch(texts, model.value.coder.topics)
                cost = one.of_tokens(model.value.edge_scores(one))
                learns = np.repeat(train, one.size)
                # words: sorted by hash
                order = np.argsort(one.hash)
                rank = np.empty(len(order), np.uint32)
                rank[order] = np.arange(len(order), dtype=np.uint32)
                h, times = one.hash[order], np.bincount(one.token[learns], minlength=len(one.known) + 1)[order].astype(np.uint32)
                cuts = _slab_cuts(h, slabs)
                some = np.flatnonzero(np.diff(cuts))
                yield _blocks(number, WORDS, some.tolist(), [pickle.dumps((_pack_rising(h[cuts[s] : cuts[s + 1]]), _pack(times[cuts[s] : cuts[s + 1]]))) for s in some])
                # stretches: sorted by context and hash
                begin, end, context, own = stretches(one)
                text = np.searchsorted(one.start, begin, "right") - 1
                order = np.lexsort((own, context))
                context, own = context[order], own[order]
                fresh = np.append(True, (context[1:] != context[:-1]) | (own[1:] != own[:-1]))[: len(order)]
                record = np.empty(len(order), np.int64)
                record[order] = np.cumsum(fresh) - 1
                context, own = context[fresh], own[fresh]
                times = np.bincount(record[train[text]], minlength=len(own)).astype(np.uint32)
                cuts = _slab_cuts(context, slabs)
                some = np.flatnonzero(np.diff(cuts))
                yield _blocks(number, STRETCHES, some.tolist(), [pickle.dumps((_pack_rising(context[cuts[s] : cuts[s + 1]]), *(_pack(x[cuts[s] : cuts[s + 1]]) for x in (own, times)))) for s in some])
                group = (np.cumsum(np.append(True, context[1:] != context[:-1])[: len(context)]) - 1)[record] if len(record) else record
                spelled_ = np.add.reduceat(cost, one.start) if n else np.zeros(0)
                upto = np.concatenate([[0.0], np.cumsum(cost)])
                rows = pa.RecordBatch.from_arrays([b.column(0).slice(at, n), held, pa.array(one.size), pa.array(spelled_), pa.array(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))], names=["id", "held_out", "n_tokens", "spelled", "n_bytes"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema) as w:
                    w.write_batch(rows)
                # only sums over a text's words are asked for, so they are held sorted in each text, which is a third of their bytes
                token = np.sort(np.repeat(np.arange(n, dtype=np.uint64) << np.uint64(32), one.size) | rank[one.token]).astype(np.uint32)
                parts = [sink.getvalue().to_pybytes(), _pack_rising(token), *(_pack(x) for x in (text.astype(np.uint32), record.astype(np.uint32), group.astype(np.uint32), (upto[end] - upto[begin]).astype(np.float32)))]
                yield _blocks(number, TEXTS, [0], [pickle.dumps(parts)])
                number += 1

    return d.mapInArrow(tidied(run), BLOCKS)


def seen_class(n: np.ndarray) -> np.ndarray:
    """The class of a context seen n times: 0 for none, then by powers of the root of two."""
    return np.minimum(CLASSES - 1, np.ceil(2 * np.log2(np.maximum(n, 1))).astype(np.int64) + 1) * (n > 0)


def counted(blocks: DataFrame) -> DataFrame:
    """BLOCKS of answers, in the order asked, and of statistics by slab."""

    def answer(t: pa.Table) -> pa.Table:
        block, kind, slab = t["block"].to_pylist(), t["kind"][0].as_py(), t["slab"][0].as_py()
        asked = [pickle.loads(x) for x in t["payload"].to_pylist()]
        sizes = np.cumsum([0, *(len(_unpack(x[-1], np.uint32)) for x in asked)])
        times = np.concatenate([_unpack(x[-1], np.uint32) for x in asked]).astype(np.int64)
        first = np.concatenate([_unpack_rising(x[0], np.uint64) for x in asked])
        if kind == WORDS:
            inverse, _ = pd.factorize(first)
            c = np.bincount(inverse, times).astype(np.int64)
            told, out = [int((c > 0).sum()), int(c.sum())], (c[inverse],)
        else:
            key = (first ^ (first >> np.uint64(33))) * _mult[17] ^ np.concatenate([_unpack(x[1], np.uint64) for x in asked])
            inverse, _ = pd.factorize(key)
            context, _ = pd.factorize(first)
            c, every = np.bincount(inverse, times).astype(np.int64)[inverse], np.bincount(context, times).astype(np.int64)[context]
            # what training tells of contexts seen so often, from each block's stretches and the other blocks' counts
            owner = np.repeat(np.arange(len(asked)), np.diff(sizes))
            own, _ = pd.factorize(context * len(asked) + owner)
            others = every - np.bincount(own, times).astype(np.int64)[own]
            k = seen_class(others)
            hits = np.bincount(k, times * ((c - times) > 0), CLASSES)
            told, out = [*hits.astype(np.int64).tolist(), *np.bincount(k, times, CLASSES).astype(np.int64).tolist()], (c, every)
        payload = [pickle.dumps(tuple(_pack(x[a:b]) for x in out)) for a, b in zip(sizes, sizes[1:])]
        n = len(block)
        return pa.table({"block": pa.array([*block, kind], pa.int64()), "kind": pa.array([kind] * n + [STATISTICS], pa.int32()), "slab": pa.array([slab] * (n + 1), pa.int32()), "payload": pa.array([*payload, None], pa.binary()), "told": pa.array([None] * n + [told], pa.list_(pa.int64()))})

    return blocks.groupBy("kind", "slab").applyInArrow(answer, BLOCKS + ", told array<bigint>")


def known_odds(hits: np.ndarray, tries: np.ndarray) -> np.ndarray:
    """Of each class of contexts, the log odds that the stretch is a known one."""
    p = np.clip((hits + 0.2) / (tries + 1.0), 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def gains(odds, train, text, record, group, cost, c, every) -> np.ndarray:
    """Of each stretch, in order: log10 of its probability over that of its spelling. train: of each text. c, every: how often it and
    its context were seen, by record and stretch."""
    n = len(text)
    if not n:
        return np.zeros(0)
    learns = train[text]
    # a training text's own stretches don't count
    own, _ = pd.factorize(text.astype(np.int64) << 32 | record)
    around, _ = pd.factorize(text.astype(np.int64) << 32 | group)
    c = c[record] - np.bincount(own, learns)[own].astype(np.int64)
    every = every[record] - np.bincount(around, learns)[around].astype(np.int64)
    tried, hit = every > 0, c > 0
    # the text's last tried stretches before this one
    before_tried, before_hit = np.concatenate([[0], np.cumsum(tried)[:-1]]), np.concatenate([[0], np.cumsum(tried & hit)[:-1]])
    first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    first = first[np.cumsum(np.append(True, text[1:] != text[:-1])) - 1]
    at = np.concatenate([[0], np.cumsum(tried & hit)])
    places = np.flatnonzero(tried)
    # from the tried stretch LOOK_BACK places back, but within the text
    low = np.maximum(before_tried - LOOK_BACK, before_tried[first])
    start = np.where(low < len(places), places[np.minimum(low, max(0, len(places) - 1))] if len(places) else 0, 0)
    h = np.where(before_tried > low, before_hit - at[start], 0)
    m = before_tried - low - h
    t = odds[seen_class(every)] + np.where(before_tried > low, np.log((h + 0.5) / (m + 0.5)), 0)
    p = np.clip(1 / (1 + np.exp(-t)), 1e-5, 1 - 1e-5)
    share = p * c / np.maximum(1, every)
    spelled_ = np.power(10.0, np.maximum(cost.astype(np.float64), -300))
    with_hit = np.log10(np.maximum(share, 1e-300) + (1 - p) * spelled_) - np.maximum(cost.astype(np.float64), -300)
    return np.where(tried, np.where(hit, with_hit, np.log10(1 - p)), 0.0)


def fitted(train: DataFrame) -> tuple[Model, int]:
    """The model of training texts (_text), and how many bytes they spell."""
    weights, topics = kinds(train)
    n_bytes = int(weights.sum())
    bits = tuple(int(min(most, max(LEAST_BITS, np.ceil(np.log2(max(1, n_bytes / 4)))))) for most in TABLE_BITS)
    model = Model(Coder(weights, topics, bits))
    rows = _numbered(learning(train, model.coder))
    digested(added(rows, _sum_learned), model)
    removed(rows)
    return model, n_bytes


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.
    held_out: a condition; what it holds for is scored but not learned from."""
    spark = docs.sparkSession
    bounded_batches(spark, ROWS)
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("_text"))
    train = docs.filter(~F.coalesce(held_out, F.lit(False))).select(F.col(text).alias("_text"))
    model, n_bytes = fitted(train)
    shared = spark.sparkContext.broadcast(model)
    slabs = max(1, -(-n_bytes // SLAB_BYTES))
    blocks = stored(spelling(d, shared, slabs))
    answers = stored(counted(blocks.filter(F.col("kind") < TEXTS)))
    sums = {(r.kind, r.pos): r.n for r in answers.filter(F.col("kind") == STATISTICS).select(F.col("block").alias("kind"), F.posexplode("told")).groupBy("kind", "pos").agg(F.sum("col").alias("n")).collect()}
    v, n = sums.get((WORDS, 0), 0), sums.get((WORDS, 1), 0)
    odds = known_odds(*(np.array([sums.get((STRETCHES, i + at), 0) for i in range(CLASSES)], float) for at in (0, CLASSES)))
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"]

    def together(t: pa.Table) -> pa.Table:
        found: dict[int, list] = {WORDS: [], STRETCHES: [], TEXTS: []}
        for k, slab, x in zip(t["kind"].to_pylist(), t["slab"].to_pylist(), t["payload"].to_pylist()):
            found[k].append((slab, x))
        ipc, *packed = pickle.loads(found[TEXTS][0][1])
        rows = pa.ipc.open_stream(ipc).read_all().combine_chunks()
        token = _unpack_rising(packed[0], np.uint32)
        text, record, group = (_unpack(x, np.uint32) for x in packed[1:4])
        cost = _unpack(packed[4], np.float32)
        joined = lambda k, i: np.concatenate([np.zeros(0, np.int64), *(_unpack(pickle.loads(x)[i], np.int64) for _, x in sorted(found[k]))])
        counts = joined(WORDS, 0)
        size = rows["n_tokens"].to_numpy()
        start = np.cumsum(size) - size
        base = np.add.reduceat(np.log10((counts + 1) / (n + v + 1))[token], start)
        known = np.add.reduceat((counts > 0).astype(np.int64)[token], start)
        train = ~rows["held_out"].to_numpy(zero_copy_only=False).astype(bool)
        more = gains(odds, train, text, record, group, cost, joined(STRETCHES, 0), joined(STRETCHES, 1))
        own = rows["spelled"].to_numpy() + np.bincount(text, more, len(size))
        n_bytes = rows["n_bytes"].to_numpy()
        per = -own * np.log2(10) / np.maximum(1, n_bytes)
        columns = [rows["id"], rows["held_out"], pa.array(size), pa.array(known), pa.array(np.full(len(size), n, np.int64)), pa.array(base), pa.array(own), pa.array(n_bytes), pa.array(per)]
        return pa.table(columns, names=[id_col, *names])

    put = blocks.filter(F.col("kind") == TEXTS).unionByName(answers.filter(F.col("kind") < TEXTS).drop("told"))
    return put.groupBy("block").applyInArrow(together, f"`{id_col}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_bytes bigint, bits_per_byte double")


def op1_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 7) == 2)


QUERIES = {"op1_context_mixing": op1_context_mixing}
ORACLE: dict[str, str] = {}
