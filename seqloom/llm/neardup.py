"""Near duplicates by an inverted join over signature coordinates.

A document's set is its distinct shingles of five words. Documents with one set form a class, and only classes go on.
A class has COORDS MinHash coordinates; it is posted under the coordinate-value pairs of a prefix of the first SHORT
ones. Two classes that agree on at least ``agree`` of those SHORT coordinates meet in that prefix (SHORT - agree + 1
coordinates) at least once. Pairs that meet count their equal coordinates over all COORDS, and those of at least ``matches``
are compared on their full sets; only links that hold there count. The threshold is a parameter, and both numbers come
from it (``Bounds``).

A posting list of m classes isn't turned into its pairs. First each member is compared with a few heads of its list,
which are found by aggregation; links found make components. Then only lists that still hold several components are
read, in blocks of bounded size: pairs of different components that reach ``matches`` are compared, each in the first list
that both share (later meetings are skipped). Members that have a crowd of such partners aren't paired: their sets are
brought together by list and block, shared shingles are counted for one member against all, and a link is given only
where it joins two components. So every pair that meets is either compared or already
connected, and no link between components is lost.

Components come from repeated contraction: every node joins the root that its smallest neighbours lead to, until no
edge is left, with each round's frames checkpointed. Texts are read again only for the classes of candidate pairs.

Chance of missing a pair at the threshold: at most MISS for the prefix and MISS_COUNT for the count.

Defined results: null and empty texts and texts without words have no shingles, are linked with nothing and are their
own component; under five words the whole sequence is the only shingle; rows with one id are one document with several
texts, linked if one of its texts is; a row without id is linked with nothing and kept; whole texts are read at any
length; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import bounded_batches, coded_words, cut, stored, table, text_slices, tidied

SHINGLE, LEAST = 5, 85
COORDS, SHORT = 64, 20
#: The chance, at most, that a pair at the threshold is missed by the prefix, and by the count.
MISS, MISS_COUNT = 1e-5, 3.1e-5
#: Members of a posting list that are compared in one go, and ids that are broadcast at most (8 MB).
BLOCK, FEW = 2048, 1_000_000
#: A member with more likely partners than this in a list is compared with them by counting, not pair by pair.
CROWD = 16


def _most(n: int, p: float, miss: float) -> int:
    """The largest m such that fewer than m of n coordinates, each equal with chance p, are equal with a chance of at most miss."""
    m, below = 0, 0.0
    while m <= n:
        below += math.comb(n, m) * p**m * (1 - p) ** (n - m)
        if below > miss:
            break
        m += 1
    return m


@dataclass(frozen=True)
class Bounds:
    """A threshold in hundredths, coordinates of the prefix, and equal coordinates that a candidate pair has at least."""

    least: int
    prefix: int
    matches: int

    @staticmethod
    def of(least: int) -> Bounds:
        return Bounds(least, SHORT - max(1, _most(SHORT, least / 100, MISS)) + 1, _most(COORDS, least / 100, MISS_COUNT))


_mult = np.random.default_rng(20).integers(0, 2**63, SHINGLE + COORDS, dtype=np.uint64) | np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(m)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Of each text, the sorted distinct 64-bit hashes of its shingles."""
    known, index, sizes = coded_words(texts)
    w = np.array([xxhash.xxh3_64_intdigest(x) for x in known], np.uint64)[index] if known else np.zeros(0, np.uint64)
    h = {}
    for k in {min(SHINGLE, int(n)) for n in np.unique(sizes) if n}:
        x = np.full(max(0, len(w) - k + 1), k * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
        for i in range(k):
            x += w[i : len(w) - k + 1 + i] * _mult[i]
        h[k] = _mix(x)
    ends = np.cumsum(sizes).tolist()
    return [np.unique(h[min(SHINGLE, n)][e - n : e - min(SHINGLE, n) + 1]) if n else np.zeros(0, np.uint64) for n, e in zip(sizes.tolist(), ends)]


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """sets x COORDS: the least 32-bit hash of each non-empty set by each coordinate."""
    every, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), COORDS), np.uint32)
    for k in range(COORDS):
        out[:, k] = np.minimum.reduceat((every * _mult[SHINGLE + k]) >> np.uint64(32), starts)
    return out


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    for b in batches:
        ids = b.column(0).to_pylist()
        for at, texts in text_slices(b.column(1)):
            yield ids[at : at + len(texts)], shingle_sets(texts)


def signed(docs: DataFrame, by: Bounds, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles, digest of the set (null if empty), coordinate-value pairs of the prefix, the coordinates as ``_packed`` has them."""

    def run(batches):
        for ids, sets in _sets(batches):
            full = [i for i, s in enumerate(sets) if len(s)]
            digest, keys, low = [None] * len(ids), [None] * len(ids), [None] * len(ids)
            if full:
                sig = signature([sets[i] for i in full])
                pairs = sig[:, : by.prefix].astype(np.int64) | (np.arange(by.prefix, dtype=np.int64) << 32)
                small = _packed(sig, by)
                for r, i in enumerate(full):
                    digest[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                    keys[i] = pairs[r]
                    low[i] = small[r].tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(low, pa.binary())],
                names=["id", "n_shingles", "digest", "keys", "low"],
            )

    bounded_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t"))
    return d.mapInArrow(tidied(run), "id bigint, n_shingles bigint, digest binary, keys array<bigint>, low binary")


def similar(a: np.ndarray, b: np.ndarray, least: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= least * (len(a) + len(b) - both)


class Sets:
    """Full sets by id, made from the texts when first asked for and stored."""

    def __init__(self, docs: DataFrame, id_col: str, text: str):
        self.docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t"))
        self.stored: DataFrame | None = None

    def of(self, ids: DataFrame) -> DataFrame:
        """id, s: at least of the ids given (a row for each of an id's texts)."""
        if self.stored is not None:
            ids = ids.join(self.stored.select("id"), "id", "left_anti")
        ids = cut(ids.distinct())
        n = ids.count()
        if n or self.stored is None:
            d = self.docs.join(F.broadcast(ids) if n <= FEW else ids, "id", "left_semi")

            def run(batches):
                for ids, sets in _sets(batches):
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "s"])

            new = stored(d.mapInArrow(tidied(run), "id bigint, s binary"))
            self.stored = new if self.stored is None else self.stored.union(new)
        return self.stored


def confirmed(pairs: DataFrame, sets: Sets, by: Bounds) -> DataFrame:
    """The pairs (a, b) whose full sets are similar. pairs: stored."""
    s = sets.of(pairs.select(F.explode(F.array("a", "b")).alias("id")))
    both = pairs.join(s.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b").join(s.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")

    def compare(batches):
        for x in batches:
            good = [similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), by.least) for p, q in zip(x.column(2).to_pylist(), x.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(tidied(compare), "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """id, label: of every node of the edges (a, b), the smallest node of its component."""
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    labels = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("label", F.col("id"))
    while not edges.isEmpty():
        # every node points to its smallest neighbour, if that is smaller; pointers are doubled until all end at a root
        to = cut(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")))
        while True:
            further = to.select(F.col("node").alias("up"), F.col("up").alias("far"))
            longer = to.join(further, "up", "left").select("node", F.coalesce("far", "up").alias("up"), F.col("far").isNotNull().alias("more"))
            longer = cut(longer)
            to = longer.select("node", "up")
            if longer.filter("more").isEmpty():
                break
        labels = cut(labels.join(to.withColumnRenamed("node", "label"), "label", "left").select("id", F.coalesce("up", "label").alias("label")))
        a, b = (to.select(F.col("node").alias(x), F.col("up").alias(f"{x}_up")) for x in "ab")
        moved = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("a_up", "a").alias("x"), F.coalesce("b_up", "b").alias("y"))
        edges = cut(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b").distinct())
    return labels


def _packed(sig: np.ndarray, by: Bounds) -> np.ndarray:
    """Rows of bytes: the prefix's coordinates whole, of the others the low byte."""
    return np.hstack([np.ascontiguousarray(sig[:, : by.prefix]).view(np.uint8), sig[:, by.prefix :].astype(np.uint8)])


def _unpacked(column, by: Bounds) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 3 * by.prefix + COORDS)
    return np.ascontiguousarray(x[:, : 4 * by.prefix]).view(np.uint32), x[:, 4 * by.prefix :]


def head_pairs(postings: DataFrame, by: Bounds) -> DataFrame:
    """(a, b): a member of a posting list and one of its two heads, with at least by.matches equal coordinates."""
    member = F.struct("id", "low")
    heads = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(member).alias("h"), F.min(F.struct(F.xxhash64("id"), "id", "low")).alias("g")).filter("n > 1")
    heads = heads.select("key", F.explode(F.array(F.struct("h.id", "h.low"), F.struct("g.id", "g.low"))).alias("h"))
    met = postings.join(heads, "key").filter("id <> h.id").select("id", "low", F.col("h.id").alias("head"), F.col("h.low").alias("head_low"))

    def run(batches):
        for x in batches:
            if x.num_rows:
                (p, q), (r, s) = _unpacked(x.column(1), by), _unpacked(x.column(3), by)
                good = (p == r).sum(axis=1) + (q == s).sum(axis=1) >= by.matches
                yield pa.RecordBatch.from_arrays([x.column(2), x.column(0)], names=["a", "b"]).filter(pa.array(good))

    return met.mapInArrow(run, "a bigint, b bigint").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], pa.Table]]:
    """Rows that agree in their first three columns, out of sorted batches."""
    key, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], 1)
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        for s, e in zip(np.append(0, cuts), np.append(cuts, len(k))):
            this = tuple(int(v) for v in k[s])
            if this != key and held:
                yield key, pa.Table.from_batches(held)
                held = []
            key = this
            held.append(b.slice(s, e - s))
    if held:
        yield key, pa.Table.from_batches(held)


def rest_pairs(postings: DataFrame, labels: DataFrame, by: Bounds) -> DataFrame:
    """What is left to compare in lists of several components: pairs (a, b) of different components with at least by.matches
    equal coordinates; and in place of the pairs of a member that has more than CROWD of them, the members of that crowd
    (key, x, y, a: list and blocks), b null."""
    p = postings.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    open_ = p.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi")
    # blocks of a long list meet in pairs: a member of block i goes to (i, j) or (j, i) for every j
    open_ = open_.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    p = p.join(open_, "key").withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    p = p.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    p = p.select("key", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), "i", "id", "label", "low")
    p = p.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "id")

    def run(batches):
        for (key, x, y), t in _in_groups(batches):
            block, ids, label, (head, low) = t["i"].to_numpy(), t["id"].to_numpy(), t["label"].to_numpy(), _unpacked(t["low"], by)
            coord = key >> 32
            crowd = np.zeros(len(ids), bool)
            out_a, out_b = [], []
            for r in range(len(ids) - 1):
                # pairs between the two blocks, or within the one
                good = label[r + 1 :] != label[r]
                if x != y:
                    good &= block[r + 1 :] != block[r]
                o = np.flatnonzero(good) + r + 1
                if len(o):
                    same = head[o] == head[r]
                    # pairs that share an earlier coordinate of the prefix have met there
                    o = o[(same.sum(axis=1) + (low[o] == low[r]).sum(axis=1) >= by.matches) & ~same[:, :coord].any(axis=1)]
                    if len(o) > CROWD:
                        crowd[r] = True
                        crowd[o] = True
                    else:
                        out_a += [int(ids[r])] * len(o)
                        out_b += ids[o].tolist()
            n, own = len(out_a), ids[crowd].tolist()
            both = [None] * n + [key] * len(own), [None] * n + [x] * len(own), [None] * n + [y] * len(own), out_a + own, out_b + [None] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(both, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["key", "x", "y", "a", "b"])

    return p.mapInArrow(tidied(run), "key bigint, x int, y int, a bigint, b bigint")


def crowd_links(crowds: DataFrame, labels: DataFrame, sets: Sets, by: Bounds) -> DataFrame:
    """(a, b): links between the components of crowds (key, x, y, id); enough of them to join what belongs together."""
    s = sets.of(crowds.select("id"))
    c = crowds.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")).join(s, "id").select("key", "x", "y", "id", "label", "s")
    c = c.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "id")

    def run(batches):
        for _, t in _in_groups(batches):
            ids, label = t["id"].to_numpy(), t["label"].to_numpy().copy()
            held = [np.frombuffer(v, np.uint64) for v in t["s"].to_pylist()]
            size = np.array(list(map(len, held)), np.int64)
            some = size > 0
            ids, label, held, size = ids[some], label[some], [h for h in held if len(h)], size[some]
            names, flat = np.unique(np.concatenate(held), return_inverse=True) if held else (np.zeros(0), np.zeros(0, np.int64))
            starts = np.cumsum(size) - size
            has, out_a, out_b = np.zeros(len(names), bool), [], []
            for r in range(len(ids)):
                own = flat[starts[r] : starts[r] + size[r]]
                has[own] = True
                both = np.add.reduceat(has[flat].astype(np.int32), starts)
                has[own] = False
                for o in np.flatnonzero((label != label[r]) & (100 * both >= by.least * (size + size[r] - both))):
                    if label[o] != label[r]:
                        out_a.append(int(ids[r]))
                        out_b.append(int(ids[o]))
                        label[label == label[o]] = label[r]
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return c.mapInArrow(tidied(run), "a bigint, b bigint")


def groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """id, n_shingles, component_id: a row per row of docs. least: the threshold, in hundredths."""
    by = Bounds.of(least)
    rows = stored(signed(docs, by, id_col, text))
    named = rows.filter("digest IS NOT NULL AND id IS NOT NULL")
    classes = stored(named.groupBy("digest").agg(F.min(F.struct("id", "keys", "low")).alias("m")).select("digest", "m.*"))
    postings = classes.select(F.explode("keys").alias("key"), "id", "low")
    sets = Sets(docs, id_col, text)
    labels = components(confirmed(stored(head_pairs(postings, by)), sets, by))
    rest = stored(rest_pairs(postings, labels, by))
    links = confirmed(rest.filter("key IS NULL").select("a", "b"), sets, by)
    links = links.union(crowd_links(rest.filter("key IS NOT NULL").select("key", "x", "y", F.col("a").alias("id")), labels, sets, by))
    labels = components(labels.select(F.col("id").alias("a"), F.col("label").alias("b")).union(links))
    # an id with several texts ties their classes together
    several = named.groupBy("id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("lo <> hi").select("id")
    ties = named.join(several, "id", "left_semi").select(F.col("id").alias("a"), "digest").join(classes.select("digest", F.col("id").alias("b")), "digest").select("a", "b")
    labels = components(labels.select(F.col("id").alias("a"), F.col("label").alias("b")).union(ties)) if not several.isEmpty() else labels
    reps = classes.select("digest", F.col("id").alias("rep")).join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    found = rows.join(reps.select("digest", F.coalesce("label", "rep").alias("label")), "digest", "left")
    return found.select("id", "n_shingles", F.coalesce("label", "id").alias("component_id"))


def op6_coordinate_join_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = groups(table(spark, sf_dir, "documents"))
    return g.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


QUERIES = {"op6_coordinate_join_neardup": op6_coordinate_join_neardup}
#: The same by an exact join of shingles with themselves, and all that is reachable over links.
ORACLE = {
    "op6_coordinate_join_neardup": r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(sh) AS sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                          ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM t)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
g AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS label FROM documents UNION SELECT g.y, r.label FROM r JOIN g ON g.x = r.doc_id),
c AS (SELECT doc_id, min(label) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)""",
}
