"""Each line's destinations: its contig's file, unmapped, and a copy in discordant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def route(lines: DataFrame, rname: str = "rname", rnext: str = "rnext", discordant: bool = True) -> DataFrame:
    """lines with dest, a row for each destination. discordant: copy lines whose mate is placed on another contig."""
    r, m = F.col(rname), F.col(rnext)
    dest = F.when(r == "*", "unmapped").otherwise(r)
    if not discordant:
        return lines.withColumn("dest", dest)
    apart = (r != "*") & (m != "*") & (m != "=") & (m != r)
    return lines.withColumn("dest", F.explode(F.array_compact(F.array(dest, F.when(apart, "discordant")))))


def contig_number(lines: DataFrame, name: str, contigs: DataFrame) -> DataFrame:
    """lines with rid, the contig's number by name; -1 for a name that no contig has."""
    x = lines.join(contigs.select(F.col("name").alias("_name"), F.col("rid").alias("_rid")), F.col(name) == F.col("_name"), "left")
    return x.withColumn("rid", F.coalesce("_rid", F.lit(-1))).drop("_name", "_rid")


def sizes(routed: DataFrame) -> DataFrame:
    """dest, bytes (with line ends) and lines of each destination."""
    return routed.groupBy("dest").agg(F.sum(F.octet_length("sam") + 1).cast("long").alias("bytes"), F.count(F.lit(1)).alias("n"))
