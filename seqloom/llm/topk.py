"""Exact top-k by inner product over multi-resolution segment statistics.

A vector is cut in segments; a segment's mean m and deviation d (root of the summed squared differences from the mean)
bound the product of two segments of n components: q.x <= n * m(q) * m(x) + d(q) * d(x). Summed over the segments this
is an upper bound of the score, that is, a lower bound of the distance. It is taken over segments of 16, then
of 4 components: only pairs whose coarse bound reaches the query's k-th best score so far are bounded
more finely, and only survivors are scored exactly, as integers.

Every query starts with a bar: its k-th best score among the FIRST longest candidates, which are sent to where the queries are. So
all parts prune from their first candidate on, and no part has to find the good ones itself.

Queries and candidates are grouped in blocks. Every query block meets every candidate block once, in a task of its own,
which holds at most QUERIES queries and one bounded part of the candidates; each task returns k rows a query, and the
parts' lists are merged by a window on the query.

Defined results: vectors that are null or hold a null or non-finite component take no part, nor do rows with a null id;
vectors of another length than the query's share no product and are no candidates for it; query rows of one id are one
query, that of the least vector; a score beyond a long is the
nearest long; ties go to the smaller id; repeated rows are candidates each; fewer than k candidates give fewer rows; an empty table gives an empty result; other
columns take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm.common import table

K, QUERIES_A_BLOCK, PART, SCALE, STEP, FIRST = 10, 2048, 16384, 1024, 1024, 2048
RATIOS = (16, 4)


def segments(x: np.ndarray, ratio: int) -> np.ndarray:
    """Of each row of x, by segments of ratio components: root(n) * mean, then deviation. A product of two rows of these is
    the bound."""
    cuts = np.arange(0, x.shape[1], ratio)
    n = np.diff(np.append(cuts, x.shape[1])).astype(np.float64)
    total = np.add.reduceat(x, cuts, axis=1)
    square = np.add.reduceat(x * x, cuts, axis=1)
    mean = total / np.sqrt(n)
    return np.hstack([mean, np.sqrt(np.maximum(square - mean * mean, 0))])


def exact(q: np.ndarray, x: np.ndarray, safe: bool) -> np.ndarray:
    """Row-wise integer products. safe: no sum leaves the integers that doubles hold."""
    if safe:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    return np.array([min(2**63 - 1, max(-(2**63), sum(int(a) * int(b) for a, b in zip(r, s)))) for r, s in zip(q, x)], np.int64)


def search(qid: np.ndarray, q: np.ndarray, xid: np.ndarray, x: np.ndarray, k: int = K, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k best of x for each of q, of those that reach its first bar: query numbers, ids, scores; and how many pairs were scored
    exactly."""
    nq, dim = q.shape
    safe = bool(dim * float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) < 2**52)
    out_q, out_id, out_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    bar = np.full(nq, -np.inf) if first is None else first.copy()  # the k-th best score so far
    levels = [r for r in RATIOS if r < dim]
    qq = {r: segments(q, r) for r in levels}
    q_len = np.sqrt((q * q).sum(axis=1))
    scored = 0
    # long vectors first: they raise the bar early
    order = np.argsort(-(x * x).sum(axis=1), kind="stable")
    for at in range(0, len(order), STEP):
        some = order[at : at + STEP]
        c, cid = x[some], xid[some]
        slack = 1e-9 * q_len * np.sqrt((c * c).sum(axis=1)).max(initial=0) + 1e-6
        low = bar - slack
        if levels:
            stats = {r: segments(c, r) for r in levels}
            i, j = np.nonzero(qq[levels[0]] @ stats[levels[0]].T >= low[:, None])
            for r in levels[1:]:
                keep = np.concatenate([np.einsum("ij,ij->i", qq[r][i[a : a + 65536]], stats[r][j[a : a + 65536]]) >= low[i[a : a + 65536]] for a in range(0, len(i), 65536)] or [np.zeros(0, bool)])
                i, j = i[keep], j[keep]
        else:
            i, j = np.nonzero(np.ones((nq, len(some)), bool))
        own = qid[i] == cid[j]
        i, j = i[~own], j[~own]
        if not len(i):
            continue
        scored += len(i)
        s = np.concatenate([exact(q[i[a : a + 65536]], c[j[a : a + 65536]], safe) for a in range(0, len(i), 65536)])
        out_q, out_id, out_s = np.concatenate([out_q, i]), np.concatenate([out_id, cid[j]]), np.concatenate([out_s, s])
        rank = np.lexsort((out_id, -out_s, out_q))
        out_q, out_id, out_s = out_q[rank], out_id[rank], out_s[rank]
        start = np.searchsorted(out_q, np.arange(nq))
        place = np.arange(len(out_q)) - start[out_q]
        full = place == k - 1
        bar[out_q[full]] = np.maximum(bar[out_q[full]], out_s[full].astype(np.float64))
        best = place < k
        out_q, out_id, out_s = out_q[best], out_id[best], out_s[best]
    return out_q, out_id, out_s, scored


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id and integer components (as doubles) of the vectors that take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    good = F.col(vector).isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(vector) > 0)
    # floor of a double stays a double here: the cast to long could overflow
    whole = F.transform(v, lambda x: F.rint(x * SCALE) - F.when(F.rint(x * SCALE) > x * SCALE, 1.0).otherwise(0.0))
    return vectors.filter(good).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and their matrix, by the vectors' length."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = a.value_lengths().to_numpy(zero_copy_only=False)
    flat, ends = a.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
    out = {}
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        out[int(n)] = rows, flat[(ends[rows] - n)[:, None] + np.arange(n)].astype(np.float64)
    return out


def barred(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """queries with bar: the k-th best score among the FIRST longest candidates (of no more bytes than that times a vector's), or none."""
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    top = candidates.orderBy(norm.desc(), "id").limit(FIRST).toArrow()
    sent = queries.sparkSession.sparkContext.broadcast((top["id"].to_numpy(), _matrix(top["v"])) if len(top) else (np.zeros(0, np.int64), {}))

    def run(batches):
        ids, by = sent.value
        for b in batches:
            bar = np.full(b.num_rows, -np.inf)
            for n, (rows, m) in _matrix(b.column(1)).items():
                if n in by and len(by[n][0]) > k and n * float(np.abs(m).max()) * float(np.abs(by[n][1]).max()) < 2**52:
                    own = b.column(0).to_numpy()[rows]
                    for at in range(0, len(rows), 1024):
                        s = m[at : at + 1024] @ by[n][1].T
                        s[own[at : at + 1024, None] == ids[by[n][0]][None, :]] = -np.inf
                        bar[rows[at : at + 1024]] = np.partition(s, -k, axis=1)[:, -k]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bar)], names=["id", "v", "bar"])

    return queries.select("id", "v").mapInArrow(run, "id bigint, v array<double>, bar double")


def nearest(queries: DataFrame, candidates: DataFrame, k: int = K, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query, not counting a candidate with the query's own id."""
    q, c = usable(queries, id_col, vector).groupBy("id").agg(F.min("v").alias("v")), usable(candidates, id_col, vector)
    n_q, n_c = q.count(), c.count()
    blocks, parts = max(1, -(-n_q // QUERIES_A_BLOCK)), max(1, -(-n_c // PART))
    spread = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    q = barred(q, c, k).withColumn("block", spread(blocks)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    c = c.withColumn("part", spread(parts)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found = []
        if len(a) and len(b):
            qs, cs = _matrix(a["v"]), _matrix(b["v"])
            a_id, b_id = a["id"].to_numpy(), b["id"].to_numpy()
            for n, (rows, m) in qs.items():
                if n in cs:
                    i, ids, s, _ = search(a_id[rows], m, b_id[cs[n][0]], cs[n][1], k, a["bar"].to_numpy()[rows])
                    found.append(pa.table({"query_id": a_id[rows][i], "vec_id": ids, "score": pa.array(s.tolist(), pa.int64())}))
        return pa.concat_tables(found) if found else pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})

    lists = q.groupBy("block", "part").cogroup(c.groupBy("block", "part")).applyInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return lists.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


def op3_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(e.filter("vec_id % 100 = 0"), e)


QUERIES = {"op3_segment_topk": op3_segment_topk}

ORACLE = {
    "op3_segment_topk": """
WITH e AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 10""",
}
