"""Removal of long repeated substrings, by suffix sorting in parts of the corpus (deep-shallow sorting).

A byte goes if a string of LENGTH bytes that covers it also starts earlier in the corpus: in a document of smaller id, or
earlier in its own.

Which suffixes can share LENGTH bytes is decided by content: in every string of LENGTH bytes the GRAM-byte substring of
least hash is an anchor, so equal strings have equal anchors at one place. Anchors (about 2.6 in 100 positions) are dealt
by their hash, so all that can match meet in one part. An anchor travels with a hash of its surroundings first: one whose
whole surroundings stand earlier needs no bytes. Only where one anchor has several different surroundings are the bytes
fetched, once for each of them.

There the suffixes that start at anchors are sorted, and so are the reversed texts before them: multikey quicksort by
characters of eight bytes to a shallow depth, then blind tries order the groups that still agree. The common prefixes of
neighbours in the two orders tell, for each place that an anchor can have in a string of LENGTH bytes, which surroundings
hold one string; the earliest keeps it.

Repeats within a task are cut down to their earliest before any shuffle, so a passage in a third of all documents sends a
row a task. Sorted streams are read in chunks; the rows of one anchor with different surroundings stand in one chunk. An anchor
with more than HOT of them is dealt out again: whatever its place in a string, two rows that share the string share most of the
bytes around it, so rows go by those bytes, once for each of a few ranges of places.

Defined results: a null text is empty; texts under LENGTH bytes lose nothing; rows with one id are documents in order of a
hash of their texts, and those with one text too are one document, each row with its result; a row without id comes last;
a whole copy of an earlier text of LENGTH bytes or more loses every byte; whole texts are read at any length; an empty
table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import bounded_batches, cut, stored, table

LENGTH, GRAM = 100, 24
REACH = LENGTH - GRAM  # bytes on either side of an anchor that a string can cover
SHALLOW = 32
#: Surroundings of an anchor that stand together, and the ranges of its places in a string by which more are dealt out.
HOT, PLACES = 2000, (0, 20, 40, 60, REACH + 1)
#: Such anchors that are broadcast at most (8 MB).
FEW = 1_000_000
PIECE = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _ODD
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


_powers = np.cumprod(np.full(PIECE + 4 * LENGTH, _BASE, np.uint64), dtype=np.uint64)
_inverses = np.cumprod(np.full(PIECE + 4 * LENGTH, _INVERSE, np.uint64), dtype=np.uint64)


def _sums(b: np.ndarray) -> np.ndarray:
    """Running sums from which ``_span`` reads the hash of any substring."""
    return np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _powers[: len(b)], dtype=np.uint64)])


def _span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return _mix((sums[end] - sums[start]) * _inverses[start] + (end - start).astype(np.uint64))


def _extreme(h: np.ndarray, w: int, f, fill) -> np.ndarray:
    """f over every w neighbours: place i stands for i .. i + w - 1."""
    n = len(h)
    full = -(-n // w) * w
    x = np.full(full, fill, h.dtype)
    x[:n] = h
    x = x.reshape(-1, w)
    ahead, back = f.accumulate(x, axis=1).ravel(), f.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(back[: n - w + 1], ahead[w - 1 : n])


def anchors(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the anchors in a text of LENGTH bytes or more, the grams' hashes, and the text's running sums."""
    sums = _sums(b)
    h = sums[GRAM:] - sums[:-GRAM]
    h *= _inverses[: len(h)]
    h = _mix(h)
    w = REACH + 1
    least = _extreme(h, w, np.minimum, np.uint64(2**64 - 1))
    pad = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    at = np.flatnonzero(_extreme(pad, w, np.maximum, np.uint64(0)) == h)
    return at, h[at], sums


def pieces(b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """A text's anchors by pieces that overlap: positions in the text, hashes, hashes of the surroundings, ends of the surroundings."""
    for off in range(0, max(1, len(b) - LENGTH + 1), PIECE):
        lo, hi = max(0, off - LENGTH), min(len(b), off + PIECE + 2 * LENGTH)
        part = b[lo:hi]
        if len(part) < LENGTH:
            continue
        at, h, sums = anchors(part)
        # anchors whose surroundings are whole in this piece, each in one piece only
        own = (at + lo >= off) & ((at + lo < off + PIECE) | (off + PIECE > len(b) - LENGTH))
        at, h = at[own], h[own]
        left, right = np.maximum(0, at - REACH), np.minimum(len(part), at + GRAM + REACH)
        # where the surroundings end with the text they are shorter, and the anchor's place in them tells so
        around = _span(sums, left, right) + (at - left).astype(np.uint64) * _ODD
        yield at + lo, h, around, right + lo


def _raw(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


# -- sorting -----------------------------------------------------------------------------------------------------------


def blind_trie(strings: list[bytes]) -> list[int]:
    """Order of equally long strings; equal ones stay in their order.

    A node holds only the place at which its branches differ, a branch only that byte: a string goes down by those bytes
    alone to some leaf, is compared with it once, and a node is put in where they part.
    """
    root: int | tuple = 0
    same: dict[int, list[int]] = {0: [0]}
    for i in range(1, len(strings)):
        s = strings[i]
        node = root
        while not isinstance(node, int):
            child = node[1].get(s[node[0]])
            node = next(iter(node[1].values())) if child is None else child
        t = strings[node]
        if s == t:
            same[node].append(i)
            continue
        same[i] = [i]
        part = _common(s, t)
        above, node = None, root
        while not isinstance(node, int) and node[0] < part:
            above, node = node, node[1][s[node[0]]]
        if not isinstance(node, int) and node[0] == part:
            node[1][s[part]] = i
        else:
            new = (part, {t[part]: node, s[part]: i})
            if above is None:
                root = new
            else:
                above[1][s[above[0]]] = new
    order: list[int] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if isinstance(node, int):
            order += same[node]
        else:
            todo += [node[1][c] for c in sorted(node[1], reverse=True)]
    return order


def _common(s: bytes, t: bytes) -> int:
    lo, hi = 0, len(s)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if s[:mid] == t[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def sort_suffixes(x: np.ndarray, size: np.ndarray, depth: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of x (strings, filled up with zeros; size: how much of each is text), and the common prefix of
    each with the one before it in that order.

    Shallow: multikey quicksort, a character being eight bytes: a group is split by its next character until the depth
    is reached or the group has one row. Deep: what still agrees goes to blind tries.
    """
    n, width = x.shape
    wide = -(-width // 8) * 8
    if wide != width:
        x = np.hstack([x, np.zeros((n, wide - width), np.uint8)])
    # of rows that agree but for their ends, the shorter ones stand first
    by_size = np.argsort(size, kind="stable")
    x = x[by_size]
    keys = np.ascontiguousarray(x).view(">u8").astype(np.uint64)
    order, group = np.arange(n), np.zeros(n, np.int64)
    for c in range(min(keys.shape[1], depth // 8)):
        many = np.bincount(group)
        open_ = many[group] > 1
        rows = np.flatnonzero(open_)
        if not len(rows):
            break
        k = keys[order[rows], c]
        rank = np.lexsort((k, group[rows]))
        order[rows] = order[rows][rank]
        k, g = k[rank], group[rows]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (g[1:] != g[:-1])])
        fresh = np.ones(n, bool)
        fresh[rows] = new
        group = np.cumsum(fresh) - 1
    cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    for s, e in zip(cuts[:-1], cuts[1:]):
        if e - s > 1:
            own = order[s:e]
            order[s:e] = own[blind_trie([x[i].tobytes() for i in own])]
    y = x[order]
    shared = np.zeros(n, np.int64)
    differ = y[1:] != y[:-1]
    shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    order = by_size[order]
    shared[1:] = np.minimum(shared[1:], np.minimum(size[order[1:]], size[order[:-1]]))
    return order, shared


def repeats(before: np.ndarray, n_before: np.ndarray, after: np.ndarray, n_after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (in corpus order) and how far before and after the anchor the bytes go that are in a string of LENGTH bytes of
    an earlier row. before: the REACH bytes before each anchor, reversed; after: the LENGTH bytes from it on."""
    n = len(before)
    of_after, shared_after = sort_suffixes(after, n_after)
    of_before, shared_before = sort_suffixes(before, n_before)
    out_row, out_left = [], []
    place = np.arange(n)
    class_a, class_b = np.empty(n, np.int64), np.empty(n, np.int64)
    for left in range(REACH + 1):
        right = LENGTH - left
        class_a[of_after] = np.cumsum(shared_after < right)
        fit = (n_before >= left) & (n_after >= right)
        # a class of one row has no earlier one
        fit &= np.bincount(class_a, minlength=n + 1)[class_a] > 1
        rows = np.flatnonzero(fit)
        if len(rows) < 2:
            continue
        if left:
            class_b[of_before] = np.cumsum(shared_before < left)
            key = class_a[rows] * (n + 1) + class_b[rows]
        else:
            key = class_a[rows]
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        again = rows[first[which] != place[: len(rows)]]
        out_row.append(again)
        out_left.append(np.full(len(again), left))
    if not out_row:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    row, left = np.concatenate(out_row), np.concatenate(out_left)
    return row, left, LENGTH - left


# -- the operator ------------------------------------------------------------------------------------------------------


ROW = "h bigint, around bigint, doc bigint, sub bigint, at int, upto int, kind tinyint"
ANCHOR, RANGE = 0, 1


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of documents (numbers) with those that touch or overlap made one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order].astype(np.int64), end[order].astype(np.int64)
    # ends counted over all documents, so that a running maximum stays within one
    wide = int(end.max()) + 1
    reach = np.maximum.accumulate(doc * wide + end) - doc * wide
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])])
    at = np.flatnonzero(new)
    return doc[at], start[at], reach[np.append(at[1:], len(doc)) - 1]


def _rows(h, around, doc, sub, at, upto, kind) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays(
        [pa.array(h), pa.array(around), pa.array(doc), pa.array(sub), pa.array(at.astype(np.int32)), pa.array(upto.astype(np.int32)), pa.array(np.full(n, kind, np.int8))],
        names=["h", "around", "doc", "sub", "at", "upto", "kind"],
    )


def anchor_rows(docs: DataFrame) -> DataFrame:
    """Anchors, each with different surroundings once a group of texts, the earliest; and ranges of those left out. docs: doc, sub, t."""

    def emit(ids, subs, held):
        at, h, around, upto, own = (np.concatenate(x) for x in zip(*held))
        ids, subs = np.array(ids, np.int64), np.array(subs, np.int64)
        rank = np.empty(len(ids), np.int64)
        rank[np.lexsort((subs, ids))] = np.arange(len(ids))
        order = np.lexsort((at, rank[own], around, h))
        h, around, own, at, upto = h[order], around[order], own[order], at[order], upto[order]
        again = np.concatenate([[False], (h[1:] == h[:-1]) & (around[1:] == around[:-1])])
        # rows of one document (all alike) don't make each other repeats
        keep = ~again
        d, s, e = merged(own[again], np.maximum(0, at[again] - REACH), upto[again])
        yield _rows(h[keep].view(np.int64), around[keep].view(np.int64), ids[own[keep]], subs[own[keep]], at[keep], upto[keep], ANCHOR)
        if len(d):
            yield _rows(ids[d] ^ subs[d], np.zeros(len(d), np.int64), ids[d], subs[d], s, e, RANGE)

    def run(batches):
        for b in batches:
            ids, subs, held, size, seen = [], [], [], 0, set()
            for doc, sub, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                raw = np.frombuffer(_raw(t.as_py()), np.uint8)
                if len(raw) < LENGTH or (doc, sub) in seen:
                    continue
                seen.add((doc, sub))
                for at, h, around, upto in pieces(raw):
                    held.append((at, h, around, upto, np.full(len(at), len(ids))))
                    size += len(at)
                ids.append(doc)
                subs.append(sub)
                if size > 600_000:
                    yield from emit(ids, subs, held)
                    ids, subs, held, size, seen = [], [], [], 0, set()
            if held:
                yield from emit(ids, subs, held)

    return docs.mapInArrow(run, ROW)


def first_look(rows: DataFrame) -> DataFrame:
    """Of the anchors, ranges of those whose surroundings stand earlier, and as anchors the first ones of several different surroundings."""
    rows = rows.repartition(F.col("h")).sortWithinPartitions("h", "around", "kind", "doc", "sub", "at")

    def run(batches):
        last = None  # the last row before this batch
        single = None  # the first row of an anchor with one surrounding so far
        for b in batches:
            if not b.num_rows:
                continue
            c = [b.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
            given = c[6] == RANGE
            if given.any():
                yield b.filter(pa.array(given))
                c = [x[~given] for x in c]
            n = len(c[0])
            if not n:
                continue
            h, around = c[0], c[1]
            same_h = np.concatenate([[last is not None and last[0] == h[0]], h[1:] == h[:-1]])
            same = same_h & np.concatenate([[last is not None and last[1] == around[0]], around[1:] == around[:-1]])
            alike = same & np.concatenate([[last is not None and last[2:5] == (c[2][0], c[3][0], c[4][0])], (c[2][1:] == c[2][:-1]) & (c[3][1:] == c[3][:-1]) & (c[4][1:] == c[4][:-1])])
            again = np.flatnonzero(same & ~alike)
            if len(again):
                yield _rows(c[2][again] ^ c[3][again], np.zeros(len(again), np.int64), c[2][again], c[3][again], np.maximum(0, c[4][again] - REACH), c[5][again], RANGE)
            # firsts of each surrounding; those of an anchor with several are wanted
            first = np.flatnonzero(~same)
            run_of = np.cumsum(~same_h)
            number = run_of[first]
            many = np.bincount(number, minlength=run_of[-1] + 1)
            # run 0 goes on from the batch before
            wanted = many[number] > 1
            wanted[number == 0] = True
            out = first[wanted]
            if len(out):
                yield _rows(h[out], around[out], c[2][out], c[3][out], c[4][out], c[5][out], ANCHOR)
            if single is not None and (number == 0).any():
                yield single
            if run_of[-1] > 0:
                single = None
                k = first[number == run_of[-1]]
                if len(k) == 1:
                    single = _rows(h[k], around[k], c[2][k], c[3][k], c[4][k], c[5][k], ANCHOR)
            elif (number == 0).any():
                single = None
            last = tuple(int(x[-1]) for x in c[:5])

    return rows.mapInArrow(run, ROW)


def surroundings(opened: DataFrame, docs: DataFrame) -> DataFrame:
    """h, doc, sub, at, n_before, bytes: of each opened anchor."""
    by_doc = opened.groupBy("doc", "sub").agg(F.collect_set(F.struct("at", "h")).alias("a"))
    both = docs.join(by_doc, ["doc", "sub"]).select("doc", "sub", "t", "a.at", "a.h")

    def run(batches):
        for b in batches:
            out = [[], [], [], [], [], []]
            for doc, sub, t, at, h in zip(*(x.to_pylist() for x in b.columns)):
                raw = _raw(t)
                for p, q in zip(at, h):
                    lo = max(0, p - REACH)
                    for x, v in zip(out, (q, doc, sub, p, p - lo, raw[lo : p + LENGTH])):
                        x.append(v)
                if len(out[0]) > 50_000:
                    yield batch(out)
                    out = [[], [], [], [], [], []]
            yield batch(out)

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["h", "doc", "sub", "at", "n_before", "bytes"])

    return both.mapInArrow(run, "h bigint, doc bigint, sub bigint, at int, n_before int, bytes binary").dropDuplicates(["h", "doc", "sub", "at"])


def _matrices(n_before: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes before each anchor, reversed, and those from it on, filled up with zeros; and how many the latter are."""
    n = len(texts)
    size = np.array(list(map(len, texts)), np.int64)
    whole = np.zeros((n, REACH + LENGTH), np.uint8)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    row = np.repeat(np.arange(n), size)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(REACH - n_before, size)
    whole[row, col] = flat
    return np.ascontiguousarray(whole[:, :REACH][:, ::-1]), np.ascontiguousarray(whole[:, REACH:]), size - n_before


def dealt(around: DataFrame, opened: DataFrame) -> DataFrame:
    """around, h of anchors with many surroundings replaced by hashes of the bytes that a string covers wherever in a range the anchor
    stands in it: a row for each range for which the text has those bytes."""
    hot = cut(opened.groupBy("h").count().filter(F.col("count") > HOT).select("h", F.lit(True).alias("hot")))
    n = hot.count()
    if not n:
        return around
    # the hot ones themselves must not meet in a task of the join
    x = around.join(F.broadcast(hot) if n <= FEW else hot, "h", "left")
    keys = []
    for lo, hi in zip(PLACES, PLACES[1:]):
        after = LENGTH + 1 - hi
        whole = (F.col("n_before") >= lo) & (F.octet_length("bytes") - F.col("n_before") >= after)
        keys.append(F.when(whole, F.xxhash64("h", F.lit(lo), F.substring("bytes", F.col("n_before") - lo + 1, F.lit(lo + after)))))
    key = F.when(F.col("hot"), F.array_compact(F.array(*keys))).otherwise(F.array("h"))
    return x.select(F.explode(key).alias("h"), "doc", "sub", "at", "n_before", "bytes")


def second_look(around: DataFrame, chunk: int = 20_000) -> DataFrame:
    """Ranges (doc, sub, at, upto) that suffix sorting of the surroundings finds."""
    around = around.repartition(F.col("h")).sortWithinPartitions("h", "doc", "sub", "at")

    def solve(t: pa.Table):
        doc, sub, at, n_before = (t[k].to_numpy().astype(np.int64) for k in ("doc", "sub", "at", "n_before"))
        order = np.lexsort((at, sub, doc))
        # an anchor that was dealt out by several keys stands here once
        same = np.append(False, (doc[order][1:] == doc[order][:-1]) & (sub[order][1:] == sub[order][:-1]) & (at[order][1:] == at[order][:-1]))
        order = order[~same[: len(order)]]
        doc, sub, at, n_before = doc[order], sub[order], at[order], n_before[order]
        texts = t["bytes"].to_pylist()
        before, after, n_after = _matrices(n_before, [texts[i] for i in order])
        row, left, right = repeats(before, n_before, after, n_after)
        number, start, end = merged(row, at[row] - left, at[row] + right)
        return pa.RecordBatch.from_arrays([pa.array(doc[number]), pa.array(sub[number]), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=["doc", "sub", "at", "upto"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            while b.num_rows:
                h = b.column(0).to_numpy()
                if n >= chunk:
                    # the chunk ends with the anchor that it is in
                    h_last = held[-1].column(0)[-1].as_py()
                    k = int(np.searchsorted(h, h_last, "right"))
                    held.append(b.slice(0, k))
                    b = b.slice(k)
                    if b.num_rows:
                        yield solve(pa.Table.from_batches(held))
                        held, n = [], 0
                else:
                    k = min(b.num_rows, chunk - n)
                    held.append(b.slice(0, k))
                    n += k
                    b = b.slice(k)
        if held:
            yield solve(pa.Table.from_batches(held))

    return around.mapInArrow(run, "doc bigint, sub bigint, at int, upto int")


def cleaned(docs: DataFrame, id_col: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """A row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256; with_text also kept, the bytes that stay."""
    spark = docs.sparkSession
    bounded_batches(spark)
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    several = not ids.groupBy("id").count().filter("count > 1").isEmpty()
    sub = F.coalesce(F.xxhash64(text), F.lit(0)) if several else F.lit(0).cast("long")
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("doc"), sub.alias("sub"), F.col(text).alias("t"), F.col(id_col).alias("id"))
    looked = stored(first_look(anchor_rows(d.select("doc", "sub", "t"))))
    spark._jvm.System.gc()  # lets Spark drop the shuffle files of what is stored
    opened = looked.filter(F.col("kind") == ANCHOR)
    more = second_look(dealt(surroundings(opened, d.select("doc", "sub", "t")), opened))
    ranges = stored(looked.filter(F.col("kind") == RANGE).select("doc", "sub", "at", "upto").union(more))
    spark._jvm.System.gc()
    by_doc = ranges.groupBy("doc", "sub").agg(F.collect_set(F.struct("at", "upto")).alias("r"))
    both = d.join(by_doc, ["doc", "sub"], "left").select("id", "t", "r.at", "r.upto")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            out = [[], [], [], [], []]
            for t, at, upto in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
                raw = _raw(t.as_py())
                _, start, end = merged(np.zeros(len(at or ()), np.int64), np.array(at or (), np.int64), np.array(upto or (), np.int64))
                edge = [0, *(x for s, e in zip(start.tolist(), end.tolist()) for x in (s, e)), len(raw)]
                rest = raw if not len(start) else b"".join(raw[s:e] for s, e in zip(edge[::2], edge[1::2]))
                for x, v in zip(out, (len(raw), len(raw) - len(rest), len(start), hashlib.sha256(rest).hexdigest(), *[rest] * with_text)):
                    x.append(v)
            cols = [pa.array(x, k) for x, k in zip(out[: 4 + with_text], (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])

    return both.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text)


def op10_deep_shallow_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(table(spark, sf_dir, "documents"))


QUERIES = {"op10_deep_shallow_dedup": op10_deep_shallow_dedup}
#: The same by all windows of 100 bytes; texts are cut in overlapping pieces, as a place far on in a string is dear to find.
ORACLE = {
    "op10_deep_shallow_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, j * 1000 AS off, substr(h, j * 2000 + 1, 2198) AS h FROM (SELECT doc_id, h, unnest(range(0, (length(h) // 2 + 999) // 1000)) AS j FROM d)),
w AS (SELECT doc_id, off + i AS i, md5(substr(h, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, off, h, unnest(range(0, least(1000, length(h) // 2 - 99))) AS i FROM b)),
f AS (SELECT k, min((doc_id, i)) AS first FROM w GROUP BY k),
a AS (SELECT doc_id, i FROM w JOIN f USING (k) WHERE (doc_id, i) > first),
o AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 1 ELSE 0 END AS new FROM a),
g AS (SELECT doc_id, min(i) AS s, max(i) + 100 AS e FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o) GROUP BY doc_id, run),
x AS (SELECT doc_id, s, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM g),
y AS (SELECT doc_id, count(*) AS n_spans, sum(e - s) AS n_removed, max(e) AS tail FROM g GROUP BY doc_id),
z AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) AS kept FROM x JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(concat(coalesce(kept, ''), substr(h, 2 * coalesce(tail, 0) + 1)))) AS kept_sha256
FROM d LEFT JOIN y USING (doc_id) LEFT JOIN z USING (doc_id)""",
}
