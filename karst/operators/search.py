"""Exact nearest neighbours and full-text search with BM25, over rows or over stored postings."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vector

DISTANCES = {
    "cosine": lambda a, b: 1 - vector.similarity(a, b),
    "euclidean": vector.distance,
    "manhattan": vector.manhattan,
    "minkowski": vector.minkowski,
}


def nearest(df: DataFrame, field: str, query: list[float], k: int, distance: str = "cosine", to: str = "distance", tie: str = "id") -> DataFrame:
    """The k rows nearest to one vector; ties by the column ``tie``. Each task keeps k rows, then those meet."""
    if distance not in DISTANCES:
        raise ValueError(f"distance is one of {sorted(DISTANCES)}")
    rows = df.withColumn(to, DISTANCES[distance](field, F.array(*(F.lit(float(x)) for x in query))))
    return rows.filter(F.col(to).isNotNull()).orderBy(F.col(to).asc(), F.col(tie).asc()).limit(k)


#: Numbers of all queries of one block, at most: 32 MB where they are broadcast. Scores that a task holds at once, at most: 16 MB.
BLOCK_NUMBERS, SCORES = 1 << 22, 1 << 21


def _least_copies(ids: np.ndarray, m: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows, in order of their ids, without those that k copies of smaller ids precede."""
    order = np.argsort(ids, kind="stable")
    copies = pd.Series([v.tobytes() for v in m[order]])
    return order[copies.groupby(copies).cumcount().to_numpy() < k]


def _distances(q: np.ndarray, m: np.ndarray, distance: str) -> np.ndarray:
    """Of each pair of rows, in the same way wherever a pair occurs, so that copies tie."""
    if distance == "cosine":
        return 1 - (q * m).sum(axis=1) / np.sqrt((q**2).sum(axis=1)) / np.sqrt((m**2).sum(axis=1))
    return np.sqrt(((q - m) ** 2).sum(axis=1))


def _nearest_in(batches: Iterator[tuple[np.ndarray, np.ndarray]], q: np.ndarray, k: int, distance: str) -> pd.DataFrame:
    """(query, id, distance) of the k rows nearest to each query, over all batches of (ids, vectors).

    A product of matrices, in parts of bounded size, names the rows that may be among the k; their distances are taken anew.
    """
    found = pd.DataFrame({"query": np.empty(0, np.int64), "id": [], "distance": np.empty(0)})
    limit, square = np.full(len(q), np.inf), (q**2).sum(axis=1)
    for ids, m in batches:
        keep = _least_copies(ids, m, k)
        parts = [found]
        for first in range(0, len(keep), SCORES):
            ids_, m_ = ids[keep[first : first + SCORES]], m[keep[first : first + SCORES]]
            length = (m_**2).sum(axis=1)
            step = max(1, SCORES // len(m_))
            for at in range(0, len(q), step):
                few = slice(at, at + step)
                score = q[few] @ m_.T
                if distance == "cosine":
                    score /= -np.sqrt(square[few])[:, None]
                    score /= np.sqrt(length)
                    score += 1
                    error = np.full(len(score), 1e-15 * (len(m_[0]) + 8))
                else:
                    score *= -2
                    score += square[few][:, None]
                    score += length
                    error = 1e-15 * (len(m_[0]) + 8) * (square[few] + length.max())
                worst = limit[few]
                most = worst if distance == "cosine" else worst**2 * (1 + 1e-14)
                if len(m_) > k and np.isinf(most).any():
                    most = np.minimum(most, np.partition(score, k - 1, axis=1)[:, k - 1])
                a, b = np.nonzero(score <= (most + 2 * error)[:, None])
                pairs = max(1, SCORES // len(m_[0]))
                for i in range(0, len(a), pairs):
                    x, y = a[i : i + pairs] + at, b[i : i + pairs]
                    parts.append(pd.DataFrame({"query": x, "id": ids_[y], "distance": _distances(q[x], m_[y], distance)}))
        if len(parts) > 1:
            found = pd.concat([x for x in parts if len(x)] or parts[:1]).sort_values(["query", "distance", "id"])
            found = found[found.groupby("query").cumcount() < k]
            last = found.groupby("query")["distance"].agg(["size", "last"])
            last = last[last["size"] == k]["last"]
            limit[last.index.to_numpy()] = last.to_numpy()
    return found


def nearest_many(df: DataFrame, field: str, queries: DataFrame, query_field: str, k: int, distance: str = "cosine", id: str = "id", query_id: str = "id") -> DataFrame:
    """(query_id, id, distance): for each of the queries the k rows nearest to it, ties by id.

    Queries are broadcast in blocks of bounded size, each against all rows; a task keeps k rows
    for each query of a block, and a bounded number of scores.  Null vectors, those that are not finite, and with
    cosine those of length 0, are near nothing.
    """
    if distance not in ("cosine", "euclidean"):
        raise ValueError("many queries go by cosine or euclidean")
    wanted = queries.select(F.col(query_id).alias("id"), F.col(query_field).cast("array<double>").alias("v")).filter("v is not null")
    spark, kind, other = df.sparkSession, df.schema[id].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    schema = f"query_id {other}, id {kind}, distance double"
    # the work goes with the product of both sides, not with the bytes of a file: rows are dealt to all cores
    rows = df.select(F.col(id).alias("id"), F.col(field).cast("array<double>").alias("v")).filter("v is not null").repartition(2 * spark.sparkContext.defaultParallelism, "id")
    found, block = None, []

    def usable(m: np.ndarray) -> np.ndarray:
        length = (m**2).sum(axis=1)
        return np.isfinite(length) & (length > 0) if distance == "cosine" else np.isfinite(length)

    def against(block: list) -> DataFrame:
        q = np.stack([v for _, v in block])
        fit = usable(q)
        given = spark.sparkContext.broadcast(([name for (name, _), f in zip(block, fit) if f], q[fit]))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, q = given.value

            def vectors():
                for x in batches:
                    if len(x) and len(q):
                        m = np.stack(x["v"].to_numpy()).astype(float)
                        fit = usable(m)
                        if fit.any():
                            yield x["id"].to_numpy()[fit], m[fit]

            found = _nearest_in(vectors(), q, k, distance)
            if len(found):
                yield pd.DataFrame({"query_id": [names[i] for i in found["query"]], "id": found["id"].to_numpy(), "distance": found["distance"].to_numpy()})

        return rows.mapInPandas(run, schema)

    for r in wanted.toLocalIterator():
        block.append((r["id"], np.array(r["v"], dtype=float)))
        if len(block) * len(r["v"]) >= BLOCK_NUMBERS:
            found, block = against(block) if found is None else found.unionByName(against(block)), []
    if block:
        found = against(block) if found is None else found.unionByName(against(block))
    if found is None:
        return spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def tokens(text: Column, pattern: str = "[^\\p{L}\\p{N}]+", lowercase: bool = True, least: int = 1) -> Column:
    """Words of a text."""
    words = F.split(F.lower(text) if lowercase else text, pattern)
    return F.filter(words, lambda w: F.char_length(w) >= least)


def terms(query: str, pattern: str = "[^\\p{L}\\p{N}]+", lowercase: bool = True, least: int = 1) -> list[str]:
    """The distinct terms of a query, cut as ``tokens`` cuts texts."""
    import regex

    return sorted({t for t in regex.split(pattern, query.lower() if lowercase else query) if t and len(t) >= least})


def _is(term: str):
    return lambda w: w == F.lit(term)


def bm25(df: DataFrame, field: str, query: str, id: str = "id", k1: float = 1.2, b: float = 0.75, all_terms: bool = False, to: str = "score") -> DataFrame:
    """(id, score) of the rows that hold a term of the query, or all of them.

    Term counts are taken inside each row, so only matching rows go on; the
    statistics of the whole table are one aggregate.
    """
    terms = sorted({t for t in re.split(r"\W+", query.lower()) if t})
    if not terms:
        raise ValueError("the query has no term")
    rows = df.select(F.col(id).alias("id"), tokens(F.coalesce(F.col(field), F.lit(""))).alias("words"))
    rows = rows.select("id", F.size("words").alias("n"), *(F.size(F.filter("words", _is(t))).alias(f"tf{i}") for i, t in enumerate(terms)))
    totals = rows.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    hits = [F.col(f"tf{i}") > 0 for i in range(len(terms))]
    test = hits[0]
    for h in hits[1:]:
        test = test & h if all_terms else test | h
    scored = F.lit(0.0)
    for i in range(len(terms)):
        tf, found = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.ln(1 + (F.col("docs") - found + 0.5) / (found + 0.5))
        scored = scored + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    # totals is a single row by construction
    return rows.filter(test).join(F.broadcast(totals)).select("id", scored.alias(to))


#: Tasks over which the postings of one term are dealt.
SPREAD = 32


@dataclass(frozen=True)
class TextIndex:
    """Postings (term, id, n, tf), each file in order of their term, and the table's statistics, under one folder.

    A search skips what can't hold its own terms, by the statistics of the files.  Building it anew is one more ``build``.
    """

    spark: SparkSession
    path: str
    options: tuple = ()

    @classmethod
    def build(cls, df: DataFrame, field: str, path: str, id: str = "id", **analyser) -> TextIndex:
        # equal words of a text lie side by side once sorted: they are counted in their row, each text is cut once
        rows = df.select(F.col(id).alias("id"), F.sort_array(tokens(F.coalesce(F.col(field), F.lit("")), **analyser)).alias("words")).withColumn("n", F.size("words"))
        firsts = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: (i == 1) | (F.get("words", i - 1) != F.get("words", i - 2)))
        rows = rows.withColumn("at", F.when(F.col("n") > 0, firsts).otherwise(F.array().cast("array<int>")))
        counted = F.transform("at", lambda i, k: F.struct(F.get("words", i - 1).alias("term"), (F.coalesce(F.get("at", k + 1), F.col("n") + 1) - i).cast("long").alias("tf")))
        # a row without a term stands for each text
        own = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("tf")))
        postings = rows.select("id", "n", F.inline(F.concat(own, counted))).select("term", "id", "n", "tf")
        # a frequent term's postings are dealt to SPREAD tasks
        dealt = postings.repartition("term", F.pmod(F.xxhash64("id"), F.lit(SPREAD)))
        dealt.sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
        texts = df.sparkSession.read.parquet(f"{path}/postings").filter("term is null")
        texts.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean")).write.mode("overwrite").parquet(f"{path}/totals")
        return cls(df.sparkSession, path, tuple(analyser.items()))

    def search(self, query: str, k1: float = 1.2, b: float = 0.75, all_terms: bool = False, to: str = "score") -> DataFrame:
        """(id, score) as ``bm25`` gives them."""
        wanted = terms(query, **dict(self.options))
        if not wanted:
            raise ValueError("the query has no term")
        hits = self.spark.read.parquet(f"{self.path}/postings").filter(F.col("term").isin(*wanted))
        # one row, and one for each term of the query
        totals = F.broadcast(self.spark.read.parquet(f"{self.path}/totals"))
        held = F.broadcast(hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
        idf = F.ln(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
        found = hits.join(held, "term").join(totals).groupBy("id").agg(F.sum(part).alias(to), F.count(F.lit(1)).alias("_terms"))
        return (found.filter(F.col("_terms") == len(wanted)) if all_terms else found).select("id", to)
