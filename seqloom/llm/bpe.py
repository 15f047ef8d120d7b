"""Byte-level BPE encoding and decoding by an index of pair occurrences.

The distinct pretokens of an Arrow batch are laid out as one linked list of symbols. An index maps each pair to all its
positions in that list. The active ranks are applied in ascending order: all positions of the pair are merged, from left
to right, and only the lists of the pairs beside them change. Texts are then put together from their pretokens, so a
pretoken is encoded once for all its occurrences.

Rank order over all words at once is the order within each word, since no merge makes a symbol that an earlier rank
needs; ``Bpe`` checks that.

Defined results: a null or empty text has no ids, and decodes to an empty text; whole texts are encoded at any length;
repeated rows give repeated rows; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from seqloom.llm.common import bounded_batches, table, tidied

#: Fixed value: the split of byte-level BPE into pretokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pretokens that a Python worker remembers; more are encoded again.
REMEMBERED = 250_000
#: Pretokens that are merged together; a pair's places are merged in numpy from so many on.
TOGETHER, LONG = 60_000, 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in vocabulary files: itself where it is visible, else one from U+0100 on."""
    seen = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in seen]
    return [chr(b) if b in seen else chr(256 + hidden.index(b)) for b in range(256)]


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        self.byte_id = [vocab[s] for s in symbols]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        born = {i: -1 for i in self.byte_id}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ", 1)
            pair, new = (vocab[a], vocab[b]), vocab[a + b]
            if not (born.get(pair[0], r) < r and born.get(pair[1], r) < r) or new in born:
                raise ValueError(f"merge {r} doesn't follow from earlier ones")
            born[new] = r
            self.rank[pair] = r
            self.made.append(new)
        self.pairs = list(self.rank)
        self.ids_of_bytes, self.base = np.array(self.byte_id, np.int32), max(vocab.values()) + 1
        keys = np.array([a * self.base + b for a, b in self.pairs], np.int64)
        self.key_ranks = np.argsort(keys)
        self.keys = keys[self.key_ranks]
        byte_of = {s: b for b, s in enumerate(symbols)}
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
        self.text_of = {i: str(i) for i in vocab.values()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split = regex.compile(PATTERN)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each pretoken, all merged together by the pair index."""
        rank, made, pairs = self.rank, self.made, self.pairs
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.int32)
        # a -1 stands before the first word and after each one; no pair reaches over it
        places_ = np.arange(1, len(flat) + 1, dtype=np.int32) + np.repeat(np.arange(len(raw), dtype=np.int32), list(map(len, raw)))
        n = len(flat) + len(raw) + 1
        symbols = np.full(n, -1, np.int32)
        symbols[places_] = self.ids_of_bytes[flat]
        afters, befores = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        # long lists of places are merged in numpy, short ones place by place, in the same memory
        symbol, after, before = memoryview(symbols), memoryview(afters), memoryview(befores)
        where: dict[int, list[int]] = {}
        active: list[int] = []

        def put(ranks: np.ndarray, at: np.ndarray) -> None:
            some = np.flatnonzero(ranks >= 0)
            order = some[np.argsort(ranks[some], kind="stable")]
            ranks, at = ranks[order], at[order].tolist()
            cuts = np.flatnonzero(np.diff(ranks, prepend=-1))
            ends = [*cuts[1:].tolist(), len(at)]
            for q, x, y in zip(ranks[cuts].tolist(), cuts.tolist(), ends):
                if q in where:
                    where[q] += at[x:y]
                else:
                    where[q] = at[x:y]
                    heapq.heappush(active, q)

        beside = np.diff(places_) == 1
        put(self.ranks_of(symbols[places_[:-1]][beside], symbols[places_[1:]][beside]), places_[:-1][beside])
        while active:
            r = heapq.heappop(active)
            a, b = pairs[r]
            new = made[r]
            places = where.pop(r)
            if len(places) >= LONG:
                i = np.sort(np.array(places, np.int32))
                i = i[(np.diff(i, prepend=-1) > 0) & (symbols[i] == a)]
                j = afters[i]
                fits = symbols[j] == b
                i, j = i[fits], j[fits]
                if a == b and len(i):
                    # of places that overlap, every other one from the left
                    at = np.arange(len(i))
                    first = np.maximum.accumulate(np.where(np.append(True, j[:-1] != i[1:]), at, 0))
                    fits = (at - first) % 2 == 0
                    i, j = i[fits], j[fits]
                symbols[i], symbols[j] = new, -2  # -2: taken
                k = afters[j]
                afters[i], befores[k] = k, i
                h, news = befores[i], np.full(len(i), new, np.int32)
                put(self.ranks_of(np.concatenate([symbols[h], news]), np.concatenate([news, symbols[k]])), np.concatenate([h, i]))
                continue
            places.sort()
            for i in places:
                if symbol[i] != a:
                    continue
                j = after[i]
                if symbol[j] != b:
                    continue
                symbol[i], symbol[j] = new, -2
                k = after[j]
                after[i] = k
                before[k] = i
                if (x := symbol[k]) >= 0 and (q := rank.get((new, x))) is not None:
                    if q in where:
                        where[q].append(i)
                    else:
                        where[q] = [i]
                        heapq.heappush(active, q)
                h = before[i]
                if (x := symbol[h]) >= 0 and (q := rank.get((x, new))) is not None:
                    if q in where:
                        where[q].append(h)
                    else:
                        where[q] = [h]
                        heapq.heappush(active, q)
        left = symbols[1:][symbols[1:] != -2]
        ends, ids = np.flatnonzero(left < 0).tolist(), left.tolist()
        return [ids[x:y] for x, y in zip([0, *(e + 1 for e in ends)], ends)]

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, or -1."""
        if not len(self.keys):
            return np.full(len(a), -1)
        key = a.astype(np.int64) * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.key_ranks[at], -1)

    def pretokens(self, text: str) -> list[str]:
        """Pretokens in order; a special token is one of them."""
        if self.special_split is None or not any(s in text for s in self.special):
            return self.split.findall(text)
        out: list[str] = []
        for k, part in enumerate(self.special_split.split(text)):
            out.extend([part] if k % 2 else self.split.findall(part))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> Bpe:
    return Bpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Known:
    """Of pretokens: their ids as text; and what they decode to, where that isn't their own text."""

    def __init__(self, bpe: Bpe):
        self.special = {s: str(i) for s, i in bpe.special.items()}
        self.ids: dict[str, str] = dict(self.special)
        self.odd: dict[str, bytes] = {}


_known: dict[str, _Known] = {}


def learn(bpe: Bpe, path: str, texts: list[list[str]]) -> _Known:
    """What is known of the pretokens of texts, and of as many earlier ones as may be remembered."""
    known = _known.setdefault(path, _Known(bpe))
    held = set().union(*texts)
    if len(known.ids) > REMEMBERED:
        known.ids = {w: x for w, x in known.ids.items() if w in held} | known.special
        known.odd = {w: x for w, x in known.odd.items() if w in held}
    new = [w for w in held if w not in known.ids]
    bytes_of, text_of = bpe.bytes_of, bpe.text_of
    for at in range(0, len(new), TOGETHER):
        some = new[at : at + TOGETHER]
        encoded = bpe.encode_words(some)
        known.ids.update(zip(some, [",".join([text_of[i] for i in ids]) for ids in encoded]))
        for w, ids in zip(some, encoded):
            decoded = b"".join([bytes_of[i] for i in ids])
            if decoded != w.encode("utf-8", "surrogatepass"):
                known.odd[w] = decoded
    return known


def _groups(texts: pa.Array, most: int = 2_000_000) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        t = t.as_py() or ""
        group.append(t)
        size += len(t)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode(docs: DataFrame, path: str | None = None, text: str = "text", keep=("doc_id",), with_ids: bool = False) -> DataFrame:
    """A row per document: the columns of keep, n_tokens, ids_sha256, decoded_sha256, and with_ids the ids as an array.

    Runs where the rows are: no shuffle. path: of the tokenizer's file, on every executor.
    """
    path = path or default_path()
    d = docs.select(*keep, text)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1])
    schema = f"{kept}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            at = 0
            for group in _groups(batch.column(len(keep))):
                split = [bpe.pretokens(t) for t in group]
                known = learn(bpe, path, split)
                n, ids_sha, decoded_sha, all_ids = [], [], [], []
                for toks in split:
                    ids = ",".join(map(known.ids.__getitem__, toks))
                    n.append(ids.count(",") + 1 if ids else 0)
                    ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                    if known.odd:
                        raw = b"".join([known.odd.get(t) or t.encode("utf-8", "surrogatepass") for t in toks])
                    else:
                        raw = "".join(toks).encode("utf-8", "surrogatepass")
                    decoded = raw.decode("utf-8", "replace")
                    decoded_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if with_ids:
                        all_ids.append(list(map(int, ids.split(","))) if ids else [])
                cols = [c.slice(at, len(group)) for c in batch.columns[: len(keep)]] + [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
                names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols.append(pa.array(all_ids, pa.list_(pa.int32())))
                    names.append("ids")
                at += len(group)
                del split, known
                yield pa.RecordBatch.from_arrays(cols, names=names)
        # a worker that waits for its next task holds nothing
        _known.clear()
        loaded.cache_clear()

    bounded_batches(docs.sparkSession)
    return d.mapInArrow(tidied(run), schema)


def decode(tokens: DataFrame, path: str | None = None, ids: str = "ids", keep=("doc_id",)) -> DataFrame:
    """A row per row of ids: the columns of keep, and text; null ids give an empty text."""
    path = path or default_path()
    d = tokens.select(*keep, ids)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            text = [bpe.decode(x or ()) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(text, pa.string())], names=[*keep, "text"])

    return d.mapInArrow(run, f"{kept}, text string")


def op4_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


QUERIES = {"op4_pair_index_bpe": op4_pair_index_bpe}
ORACLE: dict[str, str] = {}
