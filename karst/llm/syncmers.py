"""Operator 7: document fingerprints from closed syncmers, with built-in functions only.

Tokens are the words, cut at \\x20 and \\x09-\\x0D; a word of more than ``LONG_WORD`` characters, as
in scripts without blanks, counts as its single characters.  ``K`` - 1 marks stand before the first and
behind the last token.  A k-mer of ``K`` consecutive tokens holds K-S+1 inner s-mers of ``S`` tokens; it is
a closed syncmer when the smallest of their hashes is the first or the last.  Whether a k-mer is chosen
depends on nothing but its own tokens, so an edit moves no anchor but those it touches.  Of
any K-S k-mers in a row at least one is chosen, so every text with a word has anchors.

``anchors`` gives each chosen k-mer with its place.  A document's fingerprint is the ``SKETCH``
smallest distinct hashes of its anchors, each with its first place, in hexadecimal.
``likeness`` matches two fingerprints positionally: anchors with equal hashes count if their
displacement is within an eighth of the longer text of the median displacement of all that
match, so an inserted or dropped passage is no loss but the same anchors in another order are.  The share of
these among the smallest hashes of both texts is the likeness.

Defined results: null text is empty text, with an empty fingerprint; two
empty fingerprints are alike (1), an empty and another are not (0); equal texts have
equal fingerprints; texts may be of any length; a table of one row follows itself; a null doc_id comes first, rows of
one doc_id are ordered by a hash of their text, and repeated rows get equal rows; an empty
table gives no rows; other columns of the input play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import as_text, documents, stage

K = 5
S = 2
SKETCH = 64
LONG_WORD = 24
MARK = "\x00"


def _once(value: Column, body) -> Column:
    """body(value), where the value is made once however often body names it, inside its lambdas too."""
    return F.get(F.transform(F.array(value), body), 0)


def words(text: Column) -> Column:
    """The tokens of a text, with marks around them; none for a text without words."""
    found = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    marks = F.array(*[F.lit(MARK)] * (K - 1))

    def marked(found: Column) -> Column:
        cut = F.flatten(F.transform(found, lambda w: F.when(F.length(w) > LONG_WORD, F.split(w, "")).otherwise(F.array(w))))
        tokens = F.when(F.exists(found, lambda w: F.length(w) > LONG_WORD), cut).otherwise(found)
        return F.when(F.size(found) > 0, F.concat(marks, tokens, marks)).otherwise(found)

    return _once(found, marked)


def _smers(tokens: Column) -> Column:
    """The hash of every s-mer, s = 2."""
    n = F.size(tokens)
    return F.zip_with(F.slice(tokens, 1, F.greatest(n - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def _chosen(smers: Column, i: Column, x: Column) -> Column:
    """The hash of the k-mer that starts at s-mer i, or null if it is no closed syncmer (or runs past the end)."""
    b, c, d = (F.get(smers, i + j) for j in (1, 2, 3))
    edge = F.least(x, d) <= F.least(b, c)
    return F.when(d.isNotNull() & edge, F.xxhash64(x, b, c, d))


def anchors(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, anchors array<struct<at, hash>>): the closed syncmers in order, at: the place of the first token, marks included."""
    rows = docs.select(F.col(id).alias("doc_id"), words(as_text(text)).alias("tokens")).withColumn("smers", _smers(F.col("tokens")))
    placed = F.transform("smers", lambda x, i: F.struct(i.alias("at"), _chosen(F.col("smers"), i, x).alias("hash")))
    return rows.select("doc_id", F.filter(placed, lambda a: a["hash"].isNotNull()).alias("anchors"))


def with_sketch(rows: DataFrame, text: str, to: str) -> DataFrame:
    """Adds column ``to``: struct<size, hashes, places>, the tokens' number and the smallest hashes with their first places."""
    rows = rows.withColumn("_tokens", words(F.col(text))).withColumn("_smers", _smers(F.col("_tokens")))
    rows = rows.withColumn("_chosen", F.transform("_smers", lambda x, i: _chosen(F.col("_smers"), i, x)))
    smallest = F.slice(F.sort_array(F.array_distinct(F.filter("_chosen", lambda h: h.isNotNull()))), 1, SKETCH)
    rows = rows.withColumn("_hashes", smallest)
    rows = rows.withColumn("_places", F.transform("_hashes", lambda h: (F.array_position(F.col("_chosen"), h) - 1).cast("int")))
    sketch = F.struct(F.size("_tokens").alias("size"), F.col("_hashes").alias("hashes"), F.col("_places").alias("places"))
    return rows.withColumn(to, sketch).drop("_tokens", "_smers", "_chosen", "_hashes", "_places")


def fingerprint(sketch: Column) -> Column:
    """16 digits of hash and 8 of place for each anchor."""
    return F.array_join(F.zip_with(sketch["hashes"], sketch["places"], lambda h, at: F.lower(F.concat(F.lpad(F.hex(h), 16, "0"), F.lpad(F.hex(at), 8, "0")))), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of anchors in common at about the same place, from two sketches."""

    def matched(a: Column, b: Column, low: Column) -> Column:
        # how far anchors in common among the smallest have moved; null for others
        place = lambda h: F.get(b["places"], (F.array_position(b["hashes"], h) - 1).cast("int"))
        moved = F.zip_with(a["hashes"], a["places"], lambda h, at: F.when(h <= F.element_at(low, -1), place(h) - at))
        return F.sort_array(F.filter(moved, lambda d: d.isNotNull()))

    def share(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        low = F.slice(F.sort_array(F.array_union(a["hashes"], b["hashes"])), 1, SKETCH)
        longer = F.greatest(a["size"], b["size"])

        def of(low: Column) -> Column:
            def near(moved: Column) -> Column:
                median = F.get(moved, F.floor(F.size(moved) / 2).cast("int"))
                return F.size(F.filter(moved, lambda d: F.abs(d - median) * 8 <= longer))

            return F.when(F.size(low) == 0, F.lit(1.0)).otherwise(_once(matched(a, b, low), near).cast("double") / F.size(low))

        return _once(low, of)

    return _once(F.struct(a.alias("a"), b.alias("b")), share)


def fingerprints(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    rows = docs.select(F.col(id).alias("doc_id"), as_text(text).alias("text"))
    return with_sketch(rows, "text", "sketch").select("doc_id", fingerprint(F.col("sketch")).alias("fingerprint"))


def successors(keys: DataFrame) -> DataFrame:
    """keys, distinct, with column next: the key struct that follows in ascending order; the last is followed by the first.

    Sorted by range, each range finds its own neighbours; only the first key of each range meets the others.
    """
    key = F.struct(*keys.columns)
    ranged = stage(keys.repartitionByRange(*keys.columns).withColumn("part", F.spark_partition_id()), "order")
    inside = Window.partitionBy("part").orderBy(*keys.columns)
    rows = ranged.withColumn("next", F.lead(key).over(inside)).withColumn("rank", F.row_number().over(inside))
    firsts = rows.filter("rank = 1").select("part", key.alias("first"))
    across = Window.orderBy("part")
    wrap = F.first("first").over(across.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = firsts.select("part", F.coalesce(F.lead("first").over(across), wrap).alias("after"))
    return rows.join(after, "part").select(*keys.columns, F.coalesce("next", "after").alias("next"))


def compare_edited(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has its last quarter replaced by as much of the next text's start.  Texts move once: one
    exchange by key serves both the rows and the lookup of what follows them.
    """
    rows = docs.select(F.col(id).alias("doc_id"), as_text(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    order = successors(rows.select("doc_id", "tie").distinct())
    sizes = rows.select(F.col("doc_id").alias("i"), F.col("tie").alias("t"), F.char_length("text").alias("n")).distinct()
    order = order.join(sizes, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("tie") == F.col("t")))
    wanted = order.select(F.col("i").alias("for_id"), F.col("t").alias("for_tie"), F.floor(F.col("n") / 4).cast("int").alias("need"), F.col("next.doc_id").alias("next_id"), F.col("next.tie").alias("next_tie"))
    # sketches are made behind the exchange of the texts, twice rather than moved with them
    nexts = with_sketch(rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("next_id")) & (F.col("tie") == F.col("next_tie"))), "text", "sketch")
    nexts = nexts.select("for_id", "for_tie", F.col("need"), F.substring("text", F.lit(1), F.col("need")).alias("start"), F.col("sketch").alias("next_sketch")).dropDuplicates(["for_id", "for_tie"])
    both = rows.join(nexts, F.col("doc_id").eqNullSafe(F.col("for_id")) & (F.col("tie") == F.col("for_tie")))
    both = with_sketch(both, "text", "sketch")
    n = F.char_length("text")
    both = both.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", F.concat(F.substring("text", F.lit(1), n - F.col("need")), F.col("start")).alias("edited"))
    both = with_sketch(both, "edited", "edited_sketch")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op7_syncmer_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare_edited(documents(spark, sf_dir))
