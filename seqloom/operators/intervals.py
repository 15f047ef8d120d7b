"""Range joins by bins, offsets, runs, top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins at least so wide; and bins for each range of a table, about.
BIN, BINS = 256, 16


def with_offsets(contigs: DataFrame, order: str, length: str, name: str = "off") -> DataFrame:
    """Contigs with their offsets in the joined text. Only names and lengths, a row a contig, pass the ordered window."""
    before = Window.orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    offsets = contigs.select(F.col(order).alias("_o"), F.col(length).alias("_l")).select("_o", F.coalesce(F.sum("_l").over(before), F.lit(0)).cast("long").alias(name))
    return contigs.join(offsets, F.col(order) == F.col("_o")).drop("_o")


def _width(span: DataFrame, begin: Column, end: Column) -> int:
    """Bins so wide that all ranges together touch few: the space they span over BINS times their number, and their mean length."""
    r = span.agg(F.min(begin), F.max(end), F.count(F.lit(1)), F.avg(end - begin)).first()
    return BIN if not r[2] else max(BIN, int((r[1] - r[0]) // (BINS * r[2])), int(r[3]))


def _bins(begin: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(begin / width), F.floor((end - 1) / width))


def locate(points: DataFrame, pos: str, ranges: DataFrame, begin: str, length: str) -> DataFrame:
    """Points with the range [begin, begin + length) that holds them: an equal join on bins, then the exact test. There are about
    BINS bins a range, however long the ranges are, so that few contigs are few rows, which Spark sends to where the points are."""
    b, e = F.col(begin), F.col(begin) + F.col(length)
    ranges = ranges.filter(F.col(length) > 0)
    width = _width(ranges, b, e)
    p = points.withColumn("_bin", F.floor(F.col(pos) / width))
    return p.join(ranges.withColumn("_bin", F.explode(_bins(b, e, width))), "_bin").filter((F.col(pos) >= b) & (F.col(pos) < e)).drop("_bin")


def overlap(a: DataFrame, b: DataFrame, keys: list[str], of_a: tuple[str, str], of_b: tuple[str, str]) -> DataFrame:
    """Pairs of intervals of one key that overlap, with how much (shared). Each pair comes from the first bin it shares."""
    width = _width(a, F.col(of_a[0]), F.col(of_a[1]))
    x = a.withColumn("_bin", F.explode(_bins(F.col(of_a[0]), F.col(of_a[1]), width)))
    y = b.withColumn("_bin", F.explode(_bins(F.col(of_b[0]), F.col(of_b[1]), width)))
    j = x.join(y, [*keys, "_bin"])
    begin, end = F.greatest(of_a[0], of_b[0]), F.least(of_a[1], of_b[1])
    return j.filter((begin < end) & (F.col("_bin") == F.floor(begin / width))).withColumn("shared", (end - begin).cast("long")).drop("_bin")


def runs(df: DataFrame, key: str, seq: str, letter: str) -> DataFrame:
    """key, beg, fin of the runs of a letter, within the row: the text is split at everything else."""
    parts = F.split(F.regexp_replace(seq, f"(?<={letter})(?!{letter})|(?<!{letter})(?={letter})", "|"), r"\|")
    x = df.select(key, F.posexplode(parts).alias("i", "part"))
    start = F.coalesce(F.sum(F.length("part")).over(Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return x.withColumn("beg", start.cast("long")).filter(F.col("part").startswith(letter)).select(key, "beg", (F.col("beg") + F.length("part")).alias("fin"))


def top(df: DataFrame, keys: list[str], order: list, n: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)


def predecessor(points: DataFrame, pos: str, starts: DataFrame, start: str, keys: list[str]) -> DataFrame:
    """Points with the row of starts of greatest start that isn't beyond them, null if there is none. One ordered window a key over
    both sides: no pairs are made."""
    more = [c for c in starts.columns if c not in keys]
    p = points.select(*keys, F.col(pos).alias("_at"), F.lit(1).alias("_side"), F.struct(*[c for c in points.columns if c not in keys]).alias("_p"), F.lit(None).cast(starts.select(F.struct(*more)).schema[0].dataType).alias("_s"))
    s = starts.select(*keys, F.col(start).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(p.schema["_p"].dataType).alias("_p"), F.struct(*more).alias("_s"))
    last = F.last("_s", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0))
    return p.unionByName(s).withColumn("_s", last).filter("_side = 1").select(*keys, "_p.*", "_s.*")


def suppressed(df: DataFrame, keys: list[str], order: list[str], begin: str, end: str, level: float, name: str, keep: list[str]) -> DataFrame:
    """keys, keep and name: whether a row, in order, is clear of the rows before it that are. A row stands in one's shadow if they share
    at least ``level`` of the shorter one's span. The rows of a key are folded in their order, within the row that holds them."""
    one = F.struct(*order, F.col(begin).cast("long").alias("_b"), F.col(end).cast("long").alias("_e"), F.struct(*keep).alias("_k"))
    rows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("_rows"))
    span = "array<struct<b:bigint,e:bigint>>"

    def step(acc, r):
        shared = lambda k: F.least(k["e"], r["_e"]) - F.greatest(k["b"], r["_b"])
        free = ~F.exists(acc["kept"], lambda k: (shared(k) > 0) & (shared(k) >= level * F.least(k["e"] - k["b"], r["_e"] - r["_b"])))
        kept = F.when(free, F.concat(acc["kept"], F.array(F.struct(r["_b"].alias("b"), r["_e"].alias("e"))))).otherwise(acc["kept"])
        return F.struct(kept.alias("kept"), F.concat(acc["free"], F.array(free)).alias("free"))

    start = F.struct(F.array().cast(span).alias("kept"), F.array().cast("array<boolean>").alias("free"))
    folded = rows.withColumn("_free", F.aggregate("_rows", start, step)["free"])
    x = folded.select(*keys, F.posexplode("_rows").alias("_i", "_r"), "_free")
    return x.select(*keys, "_r._k.*", F.get("_free", "_i").alias(name))
