"""Operator 3: vector best-fit packing of tokenised documents into sequences.

A piece is a vector of three sizes: tokens, documents (1) and attention cost
(tokens squared).  A sequence has a capacity in each.  Pieces come in decreasing
order; each goes to the open sequence that scores best among those with room in
*every* dimension, else opens a new one.  Scores, with capacities scaled to 1:

* ``"norm"``: the smallest weighted norm of what would be left, or
* ``"dot"``: the largest weighted dot product of the piece and what is left.

The query's capacities are ``MAX_TOKENS`` tokens, ``MAX_DOCS`` documents and the attention
cost of one full piece; all three are weighed (``WEIGHTS``), tokens most.

The corpus is dealt into shards of about ``shard_pieces`` pieces by a hash of each
row's own number, so no key decides a shard's size; each shard is packed by
one task, and leaves at most about one sequence short of full.  Pieces that fill a sequence alone
are placed without any packing.

Defined results: null text is empty text and still one piece, its end id; only
documents longer than ``max_tokens`` are cut, losslessly, the last piece short; texts may be of
any length; of pieces of equal length those of smaller doc_ids are placed first; repeated rows
are packed once each; an empty table gives no rows; columns of the
input other than id and text play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import as_text, documents, stage
from .tokens import END_ID, chunks

MAX_TOKENS = 2048
#: Documents, and sum of squared lengths, that a sequence may hold; and what tokens, documents and attention weigh.
MAX_DOCS, MAX_ATTENTION = 128, MAX_TOKENS**2
WEIGHTS = (1.0, 0.05, 0.05)
#: Pieces packed together by one task.
SHARD_PIECES = 16_000
PIECES = "doc_id long, piece int, start long, length long, ids binary"


#: Bytes of ids that a task gathers before it hands them on.
FLUSH = 1 << 24


def token_pieces(docs: DataFrame, path: str, max_tokens: int = MAX_TOKENS, text: str = "text", id: str = "doc_id", id_type: str = "<u4") -> DataFrame:
    """(doc_id, piece, start, length, ids): every document's ids and its end id, cut where longer than max_tokens.

    ids are packed little-endian integers of ``id_type``.
    """
    size = np.dtype(id_type).itemsize
    end = np.array([END_ID], dtype=id_type).tobytes()
    names = ["doc_id", "piece", "start", "length", "ids"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = chunks(path, id_type)
        rows, held = [], 0
        for x in batches:
            for doc_id, t in zip(x["id"], x["text"]):
                ids = table.encode(t) + end
                n = len(ids) // size
                for k, at in enumerate(range(0, n, max_tokens)):
                    part = ids[at * size : (at + max_tokens) * size]
                    rows.append((doc_id, k, at, len(part) // size, part))
                held += len(ids)
                if held > FLUSH:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
        yield pd.DataFrame(rows, columns=names)

    return docs.select(F.col(id).cast("long").alias("id"), as_text(text).alias("text")).mapInPandas(run, PIECES)


def vector_best_fit(sizes: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm") -> np.ndarray:
    """The bin of each item. sizes: items x dimensions, each item within capacity; bins are numbered from 0."""
    if rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule {rule!r}")
    unit = sizes / capacity
    order = np.lexsort((np.arange(len(sizes)), -(unit * weights).sum(axis=1)))
    smallest = sizes.min(axis=0) if len(sizes) else capacity
    out = np.empty(len(sizes), dtype=np.int64)
    left = np.empty((256, sizes.shape[1]), dtype=np.float64)  # what is left in the open bins, and their numbers
    name = np.empty(256, dtype=np.int64)
    n = made = 0
    for i in order:
        need = sizes[i]
        fits = np.flatnonzero((left[:n] >= need).all(axis=1))
        if len(fits):
            room = left[fits] / capacity
            score = -(weights * (room - unit[i]) ** 2).sum(axis=1) if rule == "norm" else (weights * room * unit[i]).sum(axis=1)
            k = fits[int(np.argmax(score))]
        else:
            if n == len(left):
                left, name = np.concatenate((left, np.empty_like(left))), np.concatenate((name, np.empty_like(name)))
            k = n
            left[k], name[k] = capacity, made
            n, made = n + 1, made + 1
        out[i] = name[k]
        left[k] -= need
        if (left[k] < smallest).any():  # nothing fits any more: the last open bin takes its place
            n -= 1
            left[k], name[k] = left[n], name[n]
    return out


def pack(pieces: DataFrame, max_tokens: int = MAX_TOKENS, max_docs: int | None = None, max_attention: int | None = None, weights: tuple = (1.0, 0.0, 0.0), rule: str = "norm", shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """pieces (doc_id, piece, length and any more columns) with sequence_id and offset.

    max_docs and max_attention (the sum of squared lengths) are unlimited when None.
    A piece that alone exceeds max_attention is refused.
    """
    capacity = np.array([max_tokens, max_docs or max_tokens, max_attention or max_tokens**2], dtype=np.float64)
    weigh = np.array(weights, dtype=np.float64)
    pieces = stage(pieces.withColumn("_place", F.monotonically_increasing_id()), "pieces")
    whole, rest = pieces.filter(F.col("length") >= max_tokens), pieces.filter(F.col("length") < max_tokens)
    shards = max(1, -(-rest.count() // shard_pieces))

    def run(key, x: pd.DataFrame) -> pd.DataFrame:
        n = x["length"].to_numpy().astype(np.float64)
        sizes = np.stack((n, np.ones(len(n)), n * n), axis=1)
        if (sizes > capacity).any():
            raise ValueError("a piece exceeds a capacity")
        x = x.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        n = x["length"].to_numpy().astype(np.float64)
        bins = vector_best_fit(np.stack((n, np.ones(len(n)), n * n), axis=1), capacity, weigh, rule)
        x["sequence_id"] = bins * shards + int(key[0])
        x["offset"] = x.groupby("sequence_id")["length"].cumsum() - x["length"]
        return x.drop(columns=["shard", "_place"])

    shard = F.pmod(F.xxhash64("_place"), F.lit(shards)).cast("int")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields if f.name != "_place"] + ["sequence_id long", "offset long"]
    packed = rest.withColumn("shard", shard).groupBy("shard").applyInPandas(run, ", ".join(kinds))
    if max_attention is not None and max_attention < max_tokens**2:
        whole = whole.withColumn("length", F.when(F.lit(False), F.col("length")).otherwise(F.raise_error(F.lit("a piece exceeds a capacity")).cast("long")))
    alone = whole.drop("_place").withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(alone)


def op3_best_fit_packing(spark, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    import public_tokenizers

    pieces = token_pieces(documents(spark, sf_dir) if docs is None else docs, public_tokenizers.path("word_bpe_49k.json"))
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), MAX_TOKENS, MAX_DOCS, MAX_ATTENTION, WEIGHTS)
