"""Operator 5: token ids as packed binary matrices.

Documents become ids and an end id; documents longer than a row of the matrix are
split without loss.  Pieces are packed best-fit-decreasing: in order of falling
length each goes to the row with the least room that still holds it.  A segment
tree over the possible capacities finds that row: leaf c counts the open rows with
c places left, and the search descends to the first non-empty leaf at or above the
length.  Written to files is, for each matrix row:

* ``ids``: ``row_tokens`` packed little-endian 16-bit ids, padded with ``PAD_ID``;
* ``cu_seqlens``: cumulative segment lengths, from 0 to the tokens used;
* ``positions``: packed 16-bit positions that restart at 0 with every segment
  (zero in the padding);
* ``doc_ids`` and ``pieces``: what each segment is a piece of.

The corpus is dealt into shards of about ``SHARD_BYTES`` of text by a hash of doc_id, piece
and the row's place in its partition, so no key decides a shard's size. The ids move once: the task that gets a
shard packs it and lays out its rows.

``PAD_ID`` is the end id too: n_tokens, and the last of cu_seqlens, tell where padding starts.

Defined results: null text is empty text, whose piece is its end id alone; texts may be of any
length; of pieces of equal length those of smaller doc_ids are placed first; repeated
rows are packed once each; a null doc_id stays null; an empty table writes an
empty table; columns of the input other than id and text play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import token_pieces
from .scratch import as_text, documents, new_path

ROW_TOKENS = 2048
PAD_ID = 0
#: Bytes of text whose pieces are packed together by one task.
SHARD_BYTES = 1 << 24


class CapacityTree:
    """Counts of open rows by places left, in a segment tree."""

    def __init__(self, capacity: int):
        self.size = 1 << max(capacity, 1).bit_length()
        self.count = [0] * (2 * self.size)
        self.open: dict[int, list[int]] = {}

    def add(self, left: int, row: int) -> None:
        self.open.setdefault(left, []).append(row)
        at = left + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and returns (row, places left) of the fullest row with at least so many places."""
        at = least + self.size
        if at >= 2 * self.size:
            return None
        while not self.count[at]:  # climb until something stands at or to the right, then descend to its first leaf
            while at & 1:
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.size:
            at *= 2
            at += not self.count[at]
        left = at - self.size
        row = self.open[left].pop()
        while at:
            self.count[at] -= 1
            at >>= 1
        return row, left


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset) of each length; rows are numbered from 0."""
    rows, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    tree, made = CapacityTree(capacity), 0
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        found = tree.take(n)
        if found is None:
            found = made, capacity
            made += 1
        row, left = found
        rows[i], offsets[i] = row, capacity - left
        if left > n:
            tree.add(left - n, row)
    return rows, offsets


MATRICES = "shard int, row long, n_tokens int, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<long>, pieces array<int>"


def laid_out(x: pd.DataFrame, shard: int, row_tokens: int) -> pd.DataFrame:
    """The matrix rows of one shard's pieces."""
    x = x.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
    lengths = x["length"].to_numpy()
    row, offset = best_fit_decreasing(lengths, row_tokens)
    order = np.lexsort((offset, row))
    starts = np.flatnonzero(np.diff(row[order], prepend=-1))
    counting = np.arange(row_tokens, dtype="<u2").tobytes()
    ids, docs, pieces = x["ids"].to_numpy(), x["doc_id"].to_numpy(), x["piece"].to_numpy()
    out = []
    for own in np.split(order, starts[1:]):
        cuts = np.concatenate(([0], np.cumsum(lengths[own])))
        padding = row_tokens - int(cuts[-1])
        out.append((
            shard,
            row[own[0]],
            int(cuts[-1]),
            b"".join(ids[own]) + np.full(padding, PAD_ID, dtype="<u2").tobytes(),
            cuts.tolist(),
            b"".join(counting[: 2 * n] for n in lengths[own]) + bytes(2 * padding),
            [None if pd.isna(d) else int(d) for d in docs[own]],
            pieces[own].tolist(),
        ))
    return pd.DataFrame(out, columns=[c.split()[0] for c in MATRICES.split(", ")])


def write_matrices(docs: DataFrame, tokenizer_path: str, path: str, row_tokens: int = ROW_TOKENS, text: str = "text", id: str = "doc_id", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Packs docs, writes the matrices to path as Parquet and returns what reads them."""
    if not 1 <= row_tokens <= 1 << 16:
        raise ValueError("a row has 1 to 65536 tokens")
    total = docs.agg(F.sum(F.octet_length(as_text(text)))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    pieces = token_pieces(docs, tokenizer_path, row_tokens, text, id, "<u2")
    shard = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), "piece", F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    rows = pieces.withColumn("shard", shard).groupBy("shard").applyInPandas(lambda key, x: laid_out(x, int(key[0]), row_tokens), MATRICES)
    rows.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def read_documents(matrices: DataFrame, row_tokens: int = ROW_TOKENS) -> DataFrame:
    """(doc_id, piece, ids) of every segment, read back from the matrices."""
    at = F.posexplode("doc_ids").alias("k", "doc_id")
    rows = matrices.select("ids", "cu_seqlens", "pieces", at)
    start, stop = F.get("cu_seqlens", F.col("k")), F.get("cu_seqlens", F.col("k") + 1)
    return rows.select("doc_id", F.get("pieces", F.col("k")).alias("piece"), F.substring("ids", start * 2 + 1, (stop - start) * 2).alias("ids"))


def op5_token_matrices(spark, sf_dir: str) -> DataFrame:
    """One row for each matrix row, as read back from the files: its digests, cumulative lengths and contents' names."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = write_matrices(documents(spark, sf_dir), path, new_path(spark, "matrices"))
    return rows.select("shard", "row", "n_tokens", F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"), "cu_seqlens", "doc_ids", "pieces")
