import collections
import hashlib
import pickle
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from karst.llm import byte_bpe, langid, packing, pseudonyms, syncmers, token_output
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


def tuples(df):
    return [tuple(r) for r in df.collect()]


# -- operator 1
def test_language_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.op1_language_id(spark, "/root/testdata/sf0.01").join(df, "doc_id")
    held = found.filter("held_out")
    assert held.count() == df.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).count() > 200
    assert held.filter("lang_pred = lang").count() / held.count() > 0.98
    assert found.filter("rejected").count() < 0.01 * found.count()
    assert found.filter("score < 0 or score > 1").isEmpty()


def test_language_messy(spark, messy, messy_df):
    model = langid.train(["the cat and the dog"] * 30 + ["der hund und die katze"] * 30, ["en"] * 30 + ["de"] * 30)
    found = {r["doc_id"]: r for r in langid.identify(messy_df, model).collect()}
    assert len(found) == len({d for d, _ in messy})
    assert all(found[d]["lang_pred"] == "und" and found[d]["rejected"] and found[d]["score"] == 0 for d in (1, 2, 3))
    assert found[4]["lang_pred"] in ("en", "de") and not found[None]["held_out"]
    kept = langid.accepted(messy_df, model)
    assert kept.columns == messy_df.columns and kept.filter("text is null").isEmpty()


def test_language_without_labels(spark, messy_df, empty_df):
    none = langid.fit(messy_df.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langid.identify(messy_df, none).collect()} == {"und"}
    single = langid.fit(messy_df)
    assert {r["lang_pred"] for r in langid.identify(messy_df, single).collect()} == {"und", "x"}
    assert langid.identify(empty_df, single).collect() == []


def test_model_ignores_rows_held_out(spark):
    df = spark.read.parquet(f"{DIR}/documents.parquet")
    spoiled = df.withColumn("lang", F.when(langid.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    assert "zz" not in langid.fit(spoiled).languages


def test_subwords_cross_blocks(monkeypatch):
    text = "abc défg hij " * 50
    whole = collections.Counter(np.concatenate(list(langid.subwords(text))).tolist())
    monkeypatch.setattr(langid, "_BLOCK", 17)
    assert collections.Counter(np.concatenate(list(langid.subwords(text))).tolist()) == whole


# -- operators 3 and 5
def brute_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    return t.encode(text or "", add_special_tokens=False).ids + [0]


def check_packing(found, rows, limit):
    pieces = sorted((d if d is not None else -1, k, at, n, crc) for d, k, at, n, crc, _, _ in found)
    expected = []
    for d, t in rows:
        ids = brute_ids(t)
        for k in range(0, len(ids), limit):
            part = ids[k : k + limit]
            expected.append((d if d is not None else -1, k // limit, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert pieces == sorted(expected)
    bins = collections.defaultdict(list)
    for _, _, _, n, _, s, at in found:
        bins[s].append((at, n))
    for members in bins.values():
        place = 0
        for at, n in sorted(members):
            assert at == place
            place += n
        assert place <= limit
    return len(bins)


def packed(df, limit, **options):
    pieces = packing.token_pieces(df, WORDS, limit).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return tuples(packing.pack(pieces, limit, **options))


@pytest.mark.parametrize("limit", [5, 2048])
def test_packing_messy(messy, messy_df, limit):
    check_packing(packed(messy_df, limit), messy, limit)


def test_special_strings(spark):
    """Strings of special tokens count as these; in other letters they are ordinary text."""
    rows = [(i, t) for i, t in enumerate(("one <|endoftext|> two", "a<|endoftext|>b", "<|startoftext|><|endoftext|>", "one <|ENDOFTEXT|> two", "<|endoftext|", "x  <|startoftext|>  Y É"))]
    assert check_packing(packed(spark.createDataFrame(rows, "doc_id long, text string"), 2048), rows, 2048) == 1


def test_copies_without_id_are_dealt_out(spark):
    df = spark.createDataFrame([(None, "the same text")] * 400, "doc_id long, text string").repartition(4)
    found = packed(df, 16, shard_pieces=50)
    assert len(found) == 400 and len({s % 8 for *_, s, _ in found}) == 8


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_documents_and_attention_decide(rule):
    """With equal tokens left, the other two dimensions choose; a binding capacity opens bins."""
    sizes = np.array([[60.0, 1, 3600], [40, 1, 1600], [40, 1, 1600], [20, 1, 400], [20, 1, 400]])
    few = packing.vector_best_fit(sizes, np.array([100.0, 2, 1e4]), np.array(packing.WEIGHTS), rule)
    assert len(set(few)) == 3 and max(np.bincount(few)) == 2
    low = packing.vector_best_fit(sizes, np.array([100.0, 9, 3800]), np.array(packing.WEIGHTS), rule)
    assert all((sizes[low == b, 2]).sum() <= 3800 for b in set(low)) and len(set(low)) > 2


def test_packing_is_tight(spark):
    rows = tuples(spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text"))
    bins = check_packing(tuples(packing.op3_best_fit_packing(spark, DIR)), rows, 2048)
    assert bins <= -(-sum(len(brute_ids(t)) for _, t in rows) // 2048) + 1


def test_no_rows(empty_df, tmp_path):
    assert packed(empty_df, 2048) == []
    assert token_output.write_matrices(empty_df, WORDS, f"file://{tmp_path}/m").collect() == []


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_constraint_holds(rule):
    rng = np.random.default_rng(1)
    n = rng.integers(1, 60, 400).astype(float)
    sizes, capacity = np.stack((n, np.ones(400), n * n), axis=1), np.array([100.0, 4, 5000])
    bins = packing.vector_best_fit(sizes, capacity, np.array([1.0, 0.5, 0.5]), rule)
    for b in np.unique(bins):
        assert (sizes[bins == b].sum(axis=0) <= capacity).all()


def test_best_fit_picks_the_fullest_room():
    sizes = np.array([[6.0, 1, 36], [5, 1, 25], [4, 1, 16], [3, 1, 9]])
    assert packing.vector_best_fit(sizes, np.array([10.0, 10, 100]), np.array([1.0, 0, 0])).tolist() == [0, 1, 0, 1]
    with pytest.raises(ValueError):
        packing.vector_best_fit(sizes, np.array([10.0, 10, 100]), np.array([1.0, 0, 0]), "worst")


def test_capacity_tree_against_a_list():
    rng = np.random.default_rng(3)
    tree, rows = token_output.CapacityTree(50), {}
    for i in range(3000):
        if rng.random() < 0.5:
            left = int(rng.integers(0, 51))
            tree.add(left, i)
            rows[i] = left
        else:
            least = int(rng.integers(0, 55))
            found = tree.take(least)
            best = min((v for v in rows.values() if v >= least), default=None)
            assert (found and found[1]) == best
            if found:
                assert rows.pop(found[0]) == found[1]


@pytest.mark.parametrize("width", [7, 2048])
def test_matrices_round_trip(messy, messy_df, tmp_path, width):
    matrices = token_output.write_matrices(messy_df, WORDS, f"file://{tmp_path}/m", width)
    for r in matrices.collect():
        cuts = r["cu_seqlens"]
        assert len(r["ids"]) == len(r["positions"]) == 2 * width and cuts[0] == 0 and cuts[-1] == r["n_tokens"] <= width
        at = np.frombuffer(r["positions"], "<u2")
        for a, b in zip(cuts, cuts[1:]):
            assert at[a:b].tolist() == list(range(b - a))
        assert not at[cuts[-1] :].any()
    docs = collections.defaultdict(list)
    for d, k, ids in tuples(token_output.read_documents(matrices)):
        docs[d].append((k, np.frombuffer(ids, "<u2").tolist()))
    for d, t in messy:
        if d not in (None, 14):
            assert [i for _, part in sorted(docs[d]) for i in part] == brute_ids(t)
    twice = sorted(docs[14])
    assert [ids for _, part in twice[::2] for ids in part] == [ids for _, part in twice[1::2] for ids in part] == brute_ids(messy[-3][1])


def test_matrices_query(spark):
    """The registered query, each row laid out again from the documents' ids."""
    ids = {d: brute_ids(t) for d, t in tuples(spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text"))}
    seen = collections.Counter()
    for r in token_output.op5_token_matrices(spark, DIR).collect():
        parts = [ids[d][k * 2048 : (k + 1) * 2048] for d, k in zip(r["doc_ids"], r["pieces"])]
        seen.update(zip(r["doc_ids"], r["pieces"]))
        assert r["cu_seqlens"] == np.cumsum([0, *map(len, parts)]).tolist() and r["n_tokens"] == sum(map(len, parts)) <= 2048
        row, at = np.zeros(2048, "<u2"), np.zeros(2048, "<u2")
        row[: r["n_tokens"]], at[: r["n_tokens"]] = np.concatenate(parts), np.concatenate([np.arange(len(p)) for p in parts])
        assert (r["ids_crc32"], r["positions_crc32"]) == (zlib.crc32(row.tobytes()), zlib.crc32(at.tobytes()))
    assert seen == collections.Counter((d, k) for d, x in ids.items() for k in range(-(-len(x) // 2048)))


# -- operator 10
@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def reference():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_messy(messy, messy_df, codec):
    own = reference()
    expected = []
    for d, t in messy:
        ids = own.encode_ordinary(t or "")
        expected.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(tuples(byte_bpe.round_trip(messy_df, codec)), key=str) == sorted(expected, key=str)


def test_bpe_encode_then_decode(messy, messy_df, empty_df, codec):
    back = byte_bpe.decode(byte_bpe.encode(messy_df, codec), codec)
    assert sorted(((r["doc_id"], bytes(r["data"])) for r in back.collect()), key=str) == sorted(((d, (t or "").encode()) for d, t in messy), key=str)
    assert byte_bpe.round_trip(empty_df, codec).collect() == []


def test_bpe_random_and_long(codec):
    import random

    own, rng = reference(), random.Random(4)
    for _ in range(500):
        s = "".join(rng.choice("ab  \n\té漢🙂'sT9-_") for _ in range(rng.randint(0, 50)))
        assert codec.encode(s).tolist() == own.encode_ordinary(s)
    s = "a" * 4000 + "xyz" * 2000
    assert codec.encode(s).tolist() == own.encode_ordinary(s)


def test_bpe_hashes_each_pre_token_once(codec, monkeypatch):
    import random

    rng, calls = random.Random(11), []
    words = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(300)})
    text = " ".join(rng.choice(words) + rng.choice(["", ",", ".\n"]) for _ in range(3000))
    fresh, hashed = pickle.loads(pickle.dumps(codec)), byte_bpe._hash
    monkeypatch.setattr(byte_bpe, "_hash", lambda key: calls.append(key) or hashed(key))
    assert fresh.encode(text).tolist() == reference().encode_ordinary(text)
    # each word, the first one without a space, and three kinds of what stands behind: merges hash nothing, chunks share words
    assert len(calls) <= len(words) + 4


def test_bpe_chunks_of_white_space(codec, monkeypatch):
    import random

    assert public_tokenizers.PATTERN in byte_bpe.SPACED
    own, rng = reference(), random.Random(12)
    parts = [" ", "  ", "\n", " \n", "\t", "\u00a0", "\u3000", "\x1c", "\x85", "a", "the", "B9", "é", "漢字", "🙂", "'s", "'", "...", "²", "\u0301", "x" * 70]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    expected = [own.encode_ordinary(t) for t in texts]
    assert [codec.encode(t).tolist() for t in texts] == expected
    for block, cache in ((16, 1 << 20), (1 << 20, 50), (3, 1)):
        monkeypatch.setattr(byte_bpe, "BLOCK", block)
        monkeypatch.setattr(byte_bpe, "CACHE", cache)
        assert [codec.encode(t).tolist() for t in texts] == expected
    other = byte_bpe.Codec({bytes([b]): b for b in range(256)} | {b"a b": 256, b" b": 257}, r"[a-z ]+|[^a-z ]+")
    assert other.encode("a b, a b").tolist() == [256, 44, 32, 256]


def test_bpe_digests_in_steps(codec, monkeypatch):
    import pyarrow as pa

    ids = [[5], [], [1, 2, 3, 4, 5, 6, 7], [], [256, 257], [300] * 9, []]
    flat, ends = np.array(sum(ids, []), "<i4"), np.cumsum([len(x) for x in ids]).tolist()
    decimal = pa.array([b" %d" % i for i in range(len(codec.token))], pa.large_binary())
    token = pa.array(codec.token, pa.large_binary())
    for step in (1, 2, 3, 7, 100):
        monkeypatch.setattr(byte_bpe, "STEP", step)
        assert byte_bpe._digests(decimal, flat, ends, 1) == [hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() for x in ids]
        assert byte_bpe._digests(token, flat, ends, 0) == [hashlib.sha256(codec.decode(x)).hexdigest() for x in ids]


def test_perfect_hash_is_minimal():
    keys = [f"k{i}".encode() for i in range(3000)]
    h = byte_bpe.PerfectHash(keys)
    assert None not in h.slots and [h.get(k) for k in keys] == list(range(3000)) and h.get(b"other") == -1
    assert byte_bpe.PerfectHash([]).get(b"x") == -1


# -- operator 7
def xx(spark, *columns):
    """XXH64 of rows of strings or longs, as the session computes it."""
    rows = sorted(set(zip(*columns)))
    kinds = ", ".join(f"c{i} {'string' if isinstance(v, str) else 'long'}" for i, v in enumerate(rows[0])) if rows else ""
    return {tuple(r[:-1]): r[-1] for r in spark.createDataFrame(rows, kinds).selectExpr("*", "xxhash64(*)").collect()} if rows else {}


def brute_sketches(spark, texts):
    """{text: (tokens, {hash: first place} of the 64 smallest)}."""
    tokens, pairs, grams = {}, set(), set()
    for t in set(texts):
        w = [x for x in re.split("[\\x20\\x09-\\x0d]+", t) if x]
        w = [y for x in w for y in (x if len(x) > 24 else [x])]
        tokens[t] = ["\0"] * 4 + w + ["\0"] * 4 if w else []
        pairs |= set(zip(tokens[t], tokens[t][1:]))
    hashes, chosen = xx(spark, *zip(*pairs)), {}
    for t, w in tokens.items():
        s = [hashes[p] for p in zip(w, w[1:])]
        chosen[t] = [(i, tuple(s[i : i + 4])) for i in range(len(s) - 3) if min(s[i], s[i + 3]) <= min(s[i + 1], s[i + 2])]
        grams |= {g for _, g in chosen[t]}
    names = xx(spark, *zip(*grams))
    out = {}
    for t, c in chosen.items():
        first = {}
        for i, g in c:
            first.setdefault(names[g], i)
        out[t] = len(tokens[t]), dict(sorted(first.items())[:64])
    return out


def brute_likeness(a, b):
    (n, x), (m, y) = a, b
    low = sorted(set(x) | set(y))[:64]
    moved = sorted(y[h] - x[h] for h in low if h in x and h in y)
    return sum(abs(d - moved[len(moved) // 2]) * 8 <= max(n, m) for d in moved) / len(low) if low else 1.0


def written(sketch):
    return "".join(f"{h & (2**64 - 1):016x}{at:08x}" for h, at in sketch[1].items())


def test_fingerprints_against_brute_force(spark):
    rows = sorted((d, t or "") for d, t in tuples(spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")))
    rows += [(10**6, "字" * 300), (10**6 + 1, ""), (10**6 + 2, "字" * 200 + "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r for r in syncmers.compare_edited(df).collect()}
    edited = {d: t[: len(t) - len(t) // 4] + following[: len(t) // 4] for (d, t), (_, following) in zip(rows, rows[1:] + rows[:1])}
    sketch = brute_sketches(spark, [t for _, t in rows] + list(edited.values()))
    for (d, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        r = found[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited[d].encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (written(sketch[t]), written(sketch[edited[d]]))
        assert r["near_edited"] == pytest.approx(brute_likeness(sketch[t], sketch[edited[d]])) and r["near_next"] == pytest.approx(brute_likeness(sketch[t], sketch[following]))
    assert len(found) == len(rows)
    mean = lambda k: sum(r[k] for r in found.values()) / len(found)
    assert mean("near_edited") > 0.5 > 0.1 > mean("near_next")


def test_closed_syncmers_in_their_places(spark):
    text = " ".join(f"w{i * i % 31}" for i in range(60))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = syncmers.anchors(df).first()["anchors"]
    assert len(got) > 10 and max(b["at"] - a["at"] for a, b in zip(got, got[1:])) <= syncmers.K - syncmers.S


def test_order_counts(spark):
    """The same passages in another order are less alike; one that is inserted takes nothing from what stays."""
    a, b = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(80))
    df = spark.createDataFrame([(a + " " + b, b + " " + a, b + " " + a[:40] + a)], "x string, y string, z string")
    for c in "xyz":
        df = syncmers.with_sketch(df, c, c + "s")
    got = df.select(syncmers.likeness(F.col("xs"), F.col("xs")).alias("same"), syncmers.likeness(F.col("xs"), F.col("ys")).alias("turned"), syncmers.likeness(F.col("ys"), F.col("zs")).alias("more")).first()
    assert got["same"] == 1.0 and got["turned"] < 0.75 < got["more"]


def test_fingerprints_messy(messy, messy_df, empty_df, spark):
    found = syncmers.compare_edited(messy_df).collect()
    assert len(found) == len(messy)
    by = {r["doc_id"]: r for r in found}
    assert by[2]["fingerprint"] == by[1]["fingerprint"] == "" and by[1]["near_edited"] == 1.0 and by[4]["fingerprint"]
    assert by[6]["near_edited"] > 0.4
    assert syncmers.compare_edited(empty_df).collect() == []
    single = syncmers.compare_edited(spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")).first()
    assert single["near_next"] == 1.0 and single["n_chars"] == 15


# -- operator 8
def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def swap(spark, *texts, key="k"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    return [(r["text"], r["pii_kinds"]) for r in pseudonyms.pseudonymise(df, key).orderBy("doc_id").collect()]


def test_formats_stay(spark):
    out = swap(
        spark, "card 4111111111111111.", "on 2024-02-29 or 29.02.2024 or 2024/02/29", "ip 10.0.0.1, mail anna.b@mail.example.com.", "call +1 (017) 555-7713 now", "ssn 123-45-6789", 'token = "%s"' % ("ab12" * 10),
        "call 555-123-4567.", "amex 3782 822463 10005", "to DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432", "at 2001:db8::8a2e:370:7334 and 2001:0db8:85a3:0000:0000:8a2e:0370:7334",
    )
    assert [k for _, k in out] == [["card"], ["date"], ["email", "ip"], ["phone"], ["ssn"], ["secret"], ["phone"], ["card"], ["iban"], ["ip6"]]
    card = re.fullmatch(r"card (\d{16})\.", out[0][0])[1]
    assert luhn(card) and card != "4111111111111111"
    days = re.fullmatch(r"on (\d{4}-\d\d-\d\d) or (\d\d)\.(\d\d)\.(\d{4}) or (\d{4})/(\d\d)/(\d\d)", out[1][0]).groups()
    assert days[0] == "-".join(days[3:0:-1]) == "-".join(days[4:]) != "2024-02-29"
    assert re.fullmatch(r"ip \d+(\.\d+){3}, mail u[0-9a-f]{16}@mail\.example\.com\.", out[2][0]) and "10.0.0.1" not in out[2][0]
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4} now", out[3][0]) and re.fullmatch(r"ssn \d{3}-\d\d-\d{4}", out[4][0])
    assert re.fullmatch(r"call \d{3}-\d{3}-\d{4}\.", out[6][0]) and "555-123-4567" not in out[6][0]
    assert luhn(re.sub(r"\D", "", out[7][0])) and re.fullmatch(r"amex \d{4} \d{6} \d{5}", out[7][0])
    one, two = re.fullmatch(r"to (DE\d\d(?: \d{4}){4} \d\d) or (GB\d\dWEST\d{14})", out[8][0]).groups()
    assert iban(one) and iban(two) and "3704" not in one
    assert re.fullmatch(r"at [0-9a-f]{4}:[0-9a-f]{3}::[0-9a-f]{4}:[0-9a-f]{3}:[0-9a-f]{4} and [0-9a-f]{4}(:[0-9a-f]{4}){7}", out[9][0]) and "2001" not in out[9][0]


def test_clean_text_stays(spark):
    clean = [
        "no number", "version 2.0.1 of 12345", "4111111111111112", "2023-02-29", "300.1.1.1", "a@b", "1.2.3.4.5", "1234567890123456789012",
        "000-00-0000 666-12-1234 123-00-4567", "std::cout << a::b", "at 12:30:45", "DE89 3704 0044 0532 0130 01", "\x01\x02 odd \x03\x04", "",
    ]
    assert [(t, k) for t, k in swap(spark, *clean)] == [(t, []) for t in clean]


def test_marks_in_a_text(spark):
    marked, plain = swap(spark, "\x01a\x03\x06 10.1.2.3\x02 \x03\x04\x05\x01", "10.1.2.3")
    assert marked == (f"\x01a\x03\x06 {plain[0]}\x02 \x03\x04\x05\x01", ["ip"])


def test_long_repetitions(spark):
    """Nothing exhausts the stack, whatever is repeated."""
    long = ["a@" + "b." * 500_000, "1-" * 500_000, "0" * 1_000_000, "z" * 1_000_000 + "@x", "1.1." * 250_000, "ab:" * 300_000, "a." * 500_000 + "@", "+1 234 " * 150_000, "DE12 ABCD " * 100_000, "@" * 1_000_000]
    assert [len(t) >= 100_000 for t, _ in swap(spark, *long)] == [True] * len(long)


# the same in plain Python
def iban(v):
    v = v.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def feistel(key, tag, l, r, a, b):
    for k in range(1, pseudonyms.ROUNDS + 1):
        h = int(hashlib.sha256("|".join((key, tag, str(k), str(r))).encode()).hexdigest()[:14], 16)
        l, r, a, b = r, (l + h) % a, b, a  # noqa: E741
    return l, r


def digits(key, tag, v, base=10):
    n, u = len(v), len(v) // 2
    l, r = feistel(key, f"{tag}{n}", int(v[:u], base), int(v[u:], base), base**u, base ** (n - u))  # noqa: E741
    show = "{:0{}d}" if base == 10 else "{:0{}x}"
    return show.format(l, u) + show.format(r, n - u)


def refill(v, new, kind="[0-9]"):
    new = iter(new)
    return "".join(next(new) if re.match(kind, c) else c for c in v)


def plain_pseudonym(kind, v, key):
    """None if v is none of the kind after all."""
    import datetime

    only = re.sub("[^0-9]", "", v)
    if kind == "email":
        at, domain = v.split("@")
        return "u" + hashlib.sha256(f"{key}|email|{at}".encode()).hexdigest()[:16] + "@" + domain
    if kind == "secret":
        seed = hashlib.sha256(f"{key}|secret|{v}".encode()).hexdigest()
        new = "".join(hashlib.sha256(f"{key}|{seed}|{i + 1}".encode()).hexdigest() for i in range(-(-len(v) // 64)))[: len(v)]
        return new.upper() if v == v.upper() else new
    if kind == "iban":
        if not iban(v) or len(only) < 4:
            return None
        new = refill(v[4:], digits(key, "iban", re.sub("[^0-9]", "", v[4:])))
        zero = (v[:2] + "00" + new).replace(" ", "")
        return f"{v[:2]}{98 - int(''.join(str(int(c, 36)) for c in zero[4:] + zero[:4])) % 97:02d}{new}"
    if kind == "ip":
        a, b, c, d = map(int, v.split("."))
        l, r = feistel(key, "ip", a * 256 + b, c * 256 + d, 65536, 65536)  # noqa: E741
        return f"{l >> 8}.{l & 255}.{r >> 8}.{r & 255}"
    if kind == "ip6":
        h = v.replace(":", "").lower()
        if not only or len(v) < 6:
            return None
        new = digits(key, "ip6", h, 16) if len(h) <= 16 else digits(key, "ip6a", h[:16], 16) + (digits(key, "ip6b", h[16:], 16) if len(h) > 17 else h[16:])
        return refill(v, new, "[0-9a-fA-F]")
    if kind == "date":
        y, m, d = (v[6:], v[3:5], v[:2]) if "." in v else (v[:4], v[5:7], v[8:])
        try:
            day = (datetime.date(int(y), int(m), int(d)) - datetime.date(1900, 1, 1)).days
        except ValueError:
            return None
        a, b = pseudonyms.DAYS
        l, r = feistel(key, "date", day // b, day % b, a, b)  # noqa: E741
        return (datetime.date(1900, 1, 1) + datetime.timedelta(l * b + r)).strftime("%d.%m.%Y" if "." in v else "%Y/%m/%d" if "/" in v else "%Y-%m-%d")
    if kind == "ssn":
        a, g, n = int(v[:3]), int(v[4:6]), int(v[7:])
        l, r = feistel(key, "ssn", (a - 1 - (a > 666)) * 99 + g - 1, n - 1, 898 * 99, 9999)  # noqa: E741
        a = l // 99 + 1
        return f"{a + (a >= 666):03d}-{l % 99 + 1:02d}-{r + 1:04d}"
    if kind == "phone":
        code = m[1] if (m := re.match(r"(\+\d{1,3})[ .\-(]", v)) else ""
        return code + refill(v[len(code) :], digits(key, "phone", re.sub("[^0-9]", "", v[len(code) :])))
    if not luhn(only):
        return None
    body = digits(key, "card", only[:-1])
    return refill(v, body + next(c for c in "0123456789" if luhn(body + c)))


def plain_pseudonymise(text, key):
    import regex

    kinds, pattern = [], "|".join(f"(?P<{k}>{p})" for k, p in pseudonyms.KINDS.items())

    def put(m):
        new = plain_pseudonym(m.lastgroup, m[0], key)
        if new is not None:
            kinds.append(m.lastgroup)
        return m[0] if new is None else new

    new = regex.sub(pattern, put, text or "", flags=regex.V0)
    return None if text is None else new, len(kinds), sorted(set(kinds))


def test_pii_against_plain_python(spark, messy, messy_df):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = tuples(df) + messy
    found = pseudonyms.pseudonymise(df.unionByName(messy_df.select("doc_id", "text")), "k").select("doc_id", "text", "n_pii", "pii_kinds")
    assert sorted(tuples(found), key=str) == sorted(((d, *plain_pseudonymise(t, "k")) for d, t in rows), key=str)
    assert len({k for _, _, _, kinds in tuples(found) for k in kinds}) > 4


def test_no_findings_without_ansi(spark):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        df = spark.createDataFrame([(1, "clean"), (2, None), (3, "10.0.0.1")], "doc_id int, text string")
        assert [r["n_pii"] for r in pseudonyms.pseudonymise(df).orderBy("doc_id").collect()] == [0, 0, 1]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_key_of_the_session(spark):
    assert pseudonyms.key_of(spark) == pseudonyms.key_of(spark) and len(pseudonyms.key_of(spark)) >= 32


def test_equal_values_stay_linked_and_keys_differ(spark):
    a, b, c = swap(spark, "x 10.1.2.3 y", "10.1.2.3", "10.1.2.4")
    assert a[0].split()[1] == b[0] != c[0]
    assert swap(spark, "10.1.2.3", key="other")[0] != b


def test_permutations(spark):
    two = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d")).select(pseudonyms.permuted_digits(F.col("d"), "k", "t").alias("v"))
    assert two.distinct().count() == 1000 and two.filter("length(v) <> 3").isEmpty()
    days = spark.sql("select explode(sequence(date'1900-01-01', date'2099-12-31')) as d").select(F.date_format("d", "yyyy-MM-dd").alias("d"))
    assert days.select(pseudonyms._date(F.col("d"), "k").alias("v")).distinct().count() == days.count() == 73049
    numbers = spark.sql("select concat_ws('-', lpad(a, 3, '0'), lpad(g, 2, '0'), lpad(s, 4, '0')) as v from (select explode(array(1, 665, 667, 899)) as a), (select explode(array(1, 50, 99)) as g), (select explode(sequence(1, 9999, 7)) as s)")
    new = numbers.select(pseudonyms._ssn(F.col("v"), "k").alias("v"))
    assert new.distinct().count() == numbers.count() and new.filter("v rlike '^(000|666|9)|-00-|-0000$' or length(v) <> 11").isEmpty()


def test_pii_messy(messy, messy_df, empty_df):
    found = pseudonyms.pseudonymise(messy_df)
    assert {"n_pii", "pii_kinds"} <= set(found.columns) and found.count() == len(messy)
    rows = {r["doc_id"]: r for r in found.collect()}
    assert rows[1]["text"] is None and rows[2]["text"] == "" and rows[9]["text"] == dict(messy[:9])[9]
    assert rows[14]["pii_kinds"] == ["card", "date", "ip"] and rows[14]["n_pii"] == 3
    assert pseudonyms.pseudonymise(empty_df).collect() == []
    with pytest.raises(ValueError):
        pseudonyms.pseudonymise(messy_df, "")
