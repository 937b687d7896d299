import collections
import hashlib
import random
import re

import duckdb
import pytest

from karst.llm import automata, components, exact, repeats, simhash, suffix_levels
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"


def tuples(df):
    return [tuple(r) for r in df.collect()]


# -- operator 4
def ascii_lower(t):
    return (t or "").translate(str.maketrans(exact.UPPER, exact.LOWER))


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[ascii_lower(t)].append(d)
    top = lambda ds: max((d for d in ds if d is not None), default=None)
    return sorted(((d, top(g := groups[ascii_lower(t)]), len(g), d == top(g), hashlib.sha256(ascii_lower(t).encode()).hexdigest()) for d, t in rows), key=str)


@pytest.mark.parametrize("options", [{}, {"key_bits": 2, "capacity": 2}, {"capacity": 1}])
def test_exact_messy(messy, messy_df, options):
    """Few key bits make unlike texts collide, so chains are compared by bytes; small buckets split."""
    found = exact.exact_duplicates(messy_df, **options).drop("bucket")
    assert sorted(tuples(found), key=str) == brute_exact(messy)


def test_probes_go_through_the_directory(spark, messy_df, monkeypatch):
    """A slot that names another bucket to the rows than to the index loses its rows."""
    write = exact.write_index

    def torn(*a):
        index, slots = write(*a)
        return index, slots.withColumn("bucket", F.col("bucket") + (F.col("slot") % 2))

    whole = exact.exact_duplicates(messy_df, capacity=2).count()
    monkeypatch.setattr(exact, "write_index", torn)
    assert exact.exact_duplicates(messy_df, capacity=2).count() < whole == messy_df.count()


def test_exact_empty(empty_df):
    assert exact.exact_duplicates(empty_df).collect() == []


def test_directory_splits_only_what_is_overfull(spark):
    entries = spark.createDataFrame([(h << 56,) for h in range(8)], "h long")
    found = {r["slot"]: (r["depth"], r["bucket"]) for r in exact.directory(entries, capacity=4).collect()}
    assert all(depth == 6 for depth, _ in found.values()) and len({b for _, b in found.values()}) == 2
    assert {r["depth"] for r in exact.directory(entries, capacity=8).collect()} == {0}
    same = spark.createDataFrame([(5,)] * 9 + [(1 << 40,)], "h long")
    assert {r["depth"] for r in exact.directory(same, capacity=4).collect()} >= {24}  # beyond any fixed depth, until hashes are equal


def test_exact_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DIR}/documents.parquet'")
    assert sorted(tuples(exact.op4_exact_dedup(spark, DIR))) == sorted(con.sql(exact.OP4_SQL).fetchall())


# -- operator 2
def brute_print(text, width=4):
    import xxhash

    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", ascii_lower(text).encode()) if w]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_near(rows, bits=4):
    prints = [brute_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, f"{p:016x}", least.get(root(i))) for i, ((d, _), p) in enumerate(zip(rows, prints))), key=str)


def test_simhash_messy(messy, messy_df):
    assert sorted(tuples(simhash.near_duplicates(messy_df)), key=str) == brute_near(messy)


def test_simhash_documents(spark):
    df = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    assert sorted(tuples(simhash.near_duplicates(df)), key=str) == brute_near(tuples(df))


def test_simhash_empty(empty_df):
    assert simhash.near_duplicates(empty_df).collect() == []


@pytest.mark.parametrize("crowd", [1, 3, 4096])
def test_links_are_whole_in_crowds(spark, crowd):
    """Clouds of fingerprints around a few centres: the crowded way finds what comparing all pairs finds."""
    rng = random.Random(5)
    prints = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(25):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << b
            prints.add(x)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    keys = simhash.variants(nodes).repartition("key").sortWithinPartitions("key")
    found = simhash.verified_links(keys, crowd=crowd)
    links = tuples(found.filter("not crowded").select("a", "b")) + tuples(simhash.crowded_links(found.filter("crowded").selectExpr("a as fp").distinct()))
    def groups(pairs):
        parent = {x: x for x in signed}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[root(a)] = root(b)
        return collections.Counter(frozenset(x for x in signed if root(x) == r) for r in {root(x) for x in signed})

    every = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    assert groups(links) == groups(every)


def test_segments():
    assert simhash.segments(4) == [(0, 21), (21, 22), (43, 21)]
    with pytest.raises(ValueError):
        simhash.near_duplicates(None, max_bits=3)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 102), (102, 101), (7, 7), (5, 4)]
    found = dict(tuples(components.connected_components(spark.createDataFrame(chain, "x long, y long").repartition(5))))
    assert found == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 104)}}
    assert components.connected_components(spark.createDataFrame([], "x long, y long")).collect() == []


# -- operators 6 and 9
def pooled(rows):
    return sorted(rows, key=lambda r: -1 if r[0] is None else r[0])


def covered(datas, length):
    count = collections.Counter()
    for b in datas:
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    for b in datas:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        yield gone


def brute_bytes(rows, length, passage=256):
    datas = [(t or "").encode() for _, t in rows]
    out = []
    for (d, _), b, gone, again in zip(rows, datas, covered(datas, length), covered(datas, min(passage, length))):
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest(), sum(again)))
    return sorted(out, key=str)


def brute_words(rows, length):
    seen, out = set(), []
    for d, t in pooled(rows):
        w = (t or "").encode().split()
        gone = [0] * len(w)
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            if k in seen:
                gone[i : i + length] = [1] * length
            seen.add(k)
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tangled():
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ab ") for _ in range(rng.randint(0, 400)))) for i in range(25)]
    rows += [(100, "x" * 500), (101, "x y " * 150), (102, None), (103, "é" * 300 + rows[3][1]), (104, rows[3][1] + " " + rows[4][1])]
    return rows


@pytest.mark.parametrize("crowd,batches,passage", [(2, 1, 40), (2, 5, 24), (512, 1, 24), (512, 5, 40)])
def test_bytes_against_brute_force(spark, tangled, crowd, batches, passage):
    df = spark.createDataFrame(tangled, "doc_id long, text string").repartition(4)
    assert sorted(tuples(suffix_levels.remove_repeats(df, 40, batches, crowd=crowd, passage=passage)), key=str) == brute_bytes(tangled, 40, passage)


def test_bytes_and_words_of_documents(spark):
    """All of sf0.01, with the query's own parameters."""
    rows = tuples(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))
    assert sorted(tuples(suffix_levels.op6_suffix_dedup(spark, "/root/testdata/sf0.01")), key=str) == brute_bytes(rows, 400)
    assert sorted(tuples(automata.op9_substring_dedup(spark, "/root/testdata/sf0.01")), key=str) == brute_words(rows, 20)


def test_the_result_rests_on_the_scans(spark, tangled, monkeypatch):
    """Without what scans against older levels hand on, matches between batches are lost."""
    df = spark.createDataFrame(tangled, "doc_id long, text string").repartition(4)
    merged = suffix_levels.SuffixLevels.merged
    monkeypatch.setattr(suffix_levels.SuffixLevels, "merged", staticmethod(lambda arrays: merged(arrays).withColumn("met", F.lit(len(arrays) < 2) & F.col("met"))))
    assert sorted(tuples(suffix_levels.remove_repeats(df, 40, 5)), key=str) != brute_bytes(tangled, 40)


def test_hot_heads_are_dealt_out(spark, tangled, monkeypatch):
    """Heads that the sample finds hot: the same rows."""
    monkeypatch.setattr(repeats, "HOT_SHARE", 1 / 4000)
    df = spark.createDataFrame(tangled, "doc_id long, text string").repartition(4)
    assert repeats.hot_heads(repeats.texts(df, "text", "doc_id"), repeats.by_words(6))
    assert sorted(tuples(suffix_levels.remove_repeats(df, 40)), key=str) == brute_bytes(tangled, 40)
    assert sorted(tuples(automata.remove_repeats(df, 6)), key=str) == brute_words(tangled, 6)


def test_words_that_a_polynomial_hash_confuses(spark):
    """A Thue-Morse word of 1024 letters and its complement agree under any polynomial hash modulo 2 ** 64."""
    word = "".join("ab"[i.bit_count() & 1] for i in range(1024))
    rows = [(i, " ".join(f"w{k}" for k in range(19)) + " " + x) for i, x in enumerate((word, word.translate(str.maketrans("ab", "ba"))))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["n_removed"] for r in automata.remove_repeats(df).collect()] == [0, 0]
    assert sorted(tuples(suffix_levels.remove_repeats(df, 1024, passage=1024)), key=str) == brute_bytes(rows, 1024, 1024)


@pytest.mark.parametrize("shard_words", [200, 10_000])
def test_broadcast_shards_against_brute_force(spark, tangled, shard_words):
    df = spark.createDataFrame(tangled, "doc_id long, text string").repartition(4)
    assert sorted(tuples(automata.remove_repeats_of_shards(df, 6, shard_words=shard_words)), key=str) == brute_words(tangled, 6)


@pytest.mark.parametrize("crowd", [2, 512])
def test_words_against_brute_force(spark, tangled, crowd):
    df = spark.createDataFrame(tangled, "doc_id long, text string").repartition(4)
    assert sorted(tuples(automata.remove_repeats(df, 6, crowd=crowd)), key=str) == brute_words(tangled, 6)


def test_messy_bytes_and_words(messy, messy_df):
    unique = {(d, t) for d, t in messy if d is not None and d != 14}
    rows = sorted(unique)
    df = messy_df.filter("doc_id is not null and doc_id <> 14")
    assert sorted(tuples(suffix_levels.remove_repeats(df)), key=str) == brute_bytes(rows, 400)
    assert sorted(tuples(automata.remove_repeats(df)), key=str) == brute_words(rows, 20)
    # rows that share an id or have none: a row each, nothing raised
    assert suffix_levels.remove_repeats(messy_df, 20).count() == len(messy)
    assert automata.remove_repeats(messy_df, 2).count() == len(messy)


def test_no_rows(empty_df):
    assert suffix_levels.remove_repeats(empty_df).collect() == []
    assert automata.remove_repeats(empty_df).collect() == []


def test_levels_merge_geometrically(spark, tangled):
    df = repeats.texts(spark.createDataFrame(tangled, "doc_id long, text string"), "text", "doc_id")
    family = suffix_levels.SuffixLevels(repeats.by_bytes(40))
    shapes = []
    for k in range(5):
        family.add(df.filter(f"doc % 5 = {k}"))
        shapes.append([level is not None for level in family.levels])
    assert shapes == [[True], [False, True], [True, True], [False, False, True], [True, False, True]]


def test_common_strings_of_bytes(spark):
    import pandas as pd

    x = pd.DataFrame([(1, 10, 0, 3, b"abcHEADdefg"), (1, 20, 5, 3, b"xbcHEADdexx"), (1, 30, 7, 0, b"HEADdef"), (2, 40, 0, 3, b"abcHEADdefg")], columns=["head", "doc", "first", "lead", "data"])
    found = suffix_levels.common_strings(repeats.by_bytes(8, head=4))(x)
    assert sorted(map(tuple, found.to_numpy().tolist())) == [(10, 1, 9), (20, 6, 14)]


def test_kept_text(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "x a b c y")], "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in automata.remove_repeats(df, 3, with_text=True).collect()} == {1: "a b c d", 2: "x y"}
    kept = {r["doc_id"]: bytes(r["kept"]) for r in suffix_levels.remove_repeats(df, 5, with_text=True).collect()}
    assert kept == {1: b"d", 2: b"x y"}


def test_automaton_statistics():
    a = automata.Automaton()
    assert a.add([1, 2, 3, 1, 2]) == 1 and a.add([9, 1]) == 7
    assert a.statistics([1, 2, 3, 9, 1, 7, 2, 9]).tolist() == [1, 2, 3, 1, 2, 0, 1, 1]
    assert a.earlier([1, 2, 3, 1, 2], 2).tolist() == [2, 3, 4, 5] and a.earlier([1, 2, 3, 1, 2], 2, 1).tolist() == [5]


def test_broadcast_matches(spark):
    docs = spark.createDataFrame([(1, "u a b c d v"), (2, None), (3, "a b")], "doc_id long, text string")
    reference = spark.createDataFrame([("a b c d",), (None,)], "text string")
    assert tuples(automata.matches(docs, reference, 3)) == [(1, 1, 5)]
    with pytest.raises(ValueError, match="at most"):
        automata.matches(docs, reference, 3, max_words=2)
