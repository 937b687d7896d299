"""Following links and edges: all of them equi joins on record ids.

Edges are a DataFrame with columns ``in`` and ``out``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType


def fetch(df: DataFrame, field: str, target: DataFrame, key: str = "id") -> DataFrame:
    """Puts the row that a link points to, as a struct, in the link's place; NULL where it points nowhere."""
    rows = target.select(F.col(key).alias("_key"), F.struct(*target.columns).alias("_row"))
    return df.join(rows, df[field] == rows["_key"], "left").withColumn(field, F.col("_row")).drop("_key", "_row")


def _ends(edges: DataFrame, direction: str) -> DataFrame:
    if direction == "both":
        pair = edges.select("in", "out")
        return pair.toDF("_from", "_to").unionByName(pair.select(F.col("out").alias("_from"), F.col("in").alias("_to")))
    if direction not in ("out", "in"):
        raise ValueError("direction is out, in or both")
    return edges.select("in", "out").toDF(*(("_from", "_to") if direction == "out" else ("_to", "_from")))


def step(df: DataFrame, edges: DataFrame, targets: DataFrame, to: str, direction: str = "out", key: str = "id", fields: list[str] | None = None) -> DataFrame:
    """df with column ``to``: the rows reached by one edge, as an array of structs; [] where there are none.

    Parallel edges count as often as they are.  Rows come in the order of their ids.
    """
    fields = fields or targets.columns
    rows = targets.select(F.col("id").alias("_to"), F.struct("id", *(f for f in fields if f != "id")).alias("_row"))
    # edges are reduced to the sources asked for before anything else moves
    hops = _ends(edges, direction).join(df.select(F.col(key).alias("_from")).distinct(), "_from", "left_semi")
    found = hops.join(rows, "_to").groupBy("_from").agg(F.array_sort(F.collect_list("_row")).alias(to))
    out = df.join(found, df[key] == found["_from"], "left").drop("_from")
    empty = F.array().cast(found.schema[to].dataType)
    return out.withColumn(to, F.coalesce(to, empty))


def path(df: DataFrame, hops: list[tuple[DataFrame, str]], targets: DataFrame, to: str, key: str = "id", fields: list[str] | None = None) -> DataFrame:
    """Several hops, each (edges, direction); column ``to`` has the distinct rows at the end."""
    at = df.select(F.col(key).alias("_origin")).distinct().withColumn("_at", F.col("_origin"))
    for edges, direction in hops:
        ends = _ends(edges, direction)
        at = at.join(ends, at["_at"] == ends["_from"]).select("_origin", F.col("_to").alias("_at")).distinct()
    return step(df, at.select(F.col("_origin").alias("in"), F.col("_at").alias("out")), targets, to, "out", key, fields)


def behind(hops: list[tuple[DataFrame, str]], targets: DataFrame, key: str = "id") -> DataFrame:
    """(id) of the rows from which some hops, each (edges, direction), lead to one of the targets.

    Walked from the targets back, a semi join for each hop: nothing is gathered.
    """
    at = targets.select(F.col(key).alias("_to"))
    for edges, direction in reversed(hops):
        at = _ends(edges, direction).join(at, "_to", "left_semi").select(F.col("_from").alias("_to")).distinct()
    return at.select(F.col("_to").alias("id"))


def check_depth(least: int, most: int | None) -> None:
    if least < 0:
        raise ValueError("depth starts at 0")
    if most is not None and most < least:
        raise ValueError("the largest depth is below the smallest")


#: Nodes, or edges, that are broadcast at most: some 40 MB.
FEW = 500_000


def _same(left: str, right: str, kind: DataType) -> Column:
    """left = right; hashes of strings come first, since ids such as customer:1 and customer:2 begin alike and are slow to sort."""
    same = F.col(left) == F.col(right)
    return (F.xxhash64(left) == F.xxhash64(right)) & same if isinstance(kind, StringType) else same


def reach(sources: DataFrame, edges: DataFrame, least: int = 1, most: int | None = None, direction: str = "out", key: str = "id", folder: str | None = None) -> DataFrame:
    """(source, node, depth): nodes whose shortest distance from a source is within bounds.

    Breadth first: each round follows the newest nodes only, and those already seen drop out by their smaller
    depth, so cycles end.  Edges and rounds are written to ``folder`` (by default
    spark.checkpoint.dir), which bounds the plan, as each round reads all before it; a search of more than
    one round needs the folder.  Without a largest depth it goes on until a round finds nothing new.
    Nodes without edges ahead are marked and not followed.  Where a round starts from few nodes, only
    their edges, and what was seen of these edges' ends, take part in it.
    """
    check_depth(least, most)
    spark = sources.sparkSession
    folder = folder or spark.conf.get("spark.checkpoint.dir", None)
    several = most is None or most > 1
    if folder is None and several:
        raise ValueError("a search of several rounds needs spark.checkpoint.dir")

    def kept(df: DataFrame) -> DataFrame:
        if folder is None:
            return df
        place = f"{folder.rstrip('/')}/karst-reach-{uuid.uuid4().hex}"
        df.write.parquet(place)
        return spark.read.schema(df.schema).parquet(place)

    pairs = _ends(edges, direction).filter(F.col("_from").isNotNull() & F.col("_to").isNotNull())
    ends, kind = pairs.distinct(), pairs.schema["_from"].dataType
    if several:
        starts = pairs.select(F.col("_from").alias("_start")).distinct()
        ends = kept(ends.join(starts, _same("_to", "_start", kind), "left").select("_from", "_to", F.col("_start").isNotNull().alias("_on")))
    else:
        ends = ends.withColumn("_on", F.lit(True))
    first = sources.select(F.col(key).alias("source")).filter("source is not null").distinct()
    new = kept(first.select("source", F.col("source").alias("node"), F.lit(0).alias("depth"), F.lit(True).alias("_on")))
    rounds, depth = [new], 0
    while most is None or depth < most:
        seen = rounds[0]
        for r in rounds[1:]:
            seen = seen.unionByName(r)
        depth += 1
        new, hops = new.filter("_on").select("source", "node"), ends
        if several:
            nodes = new.select(F.col("node").alias("_from")).distinct()
            count = nodes.count()
            if not count:
                break
            if count <= FEW:
                hops = kept(ends.join(F.broadcast(nodes), "_from", "left_semi"))
                if hops.count() <= FEW:
                    hops = F.broadcast(hops)
                    seen = seen.join(F.broadcast(hops.select(F.col("_to").alias("node")).distinct()), "node", "left_semi").select(seen.columns)
        ahead = new.join(hops, _same("node", "_from", kind)).select("source", F.col("_to").alias("node"), F.lit(depth).alias("depth"), "_on")
        shortest = seen.unionByName(ahead).groupBy("source", "node").agg(F.min("depth").alias("depth"), F.max("_on").alias("_on"))
        new = kept(shortest.filter(F.col("depth") == depth))
        rounds.append(new)
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out.filter(F.col("depth") >= least).select("source", "node", "depth")
