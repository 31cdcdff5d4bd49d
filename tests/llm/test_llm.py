import collections
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphtrail.llm import decontamination, fingerprints, html, langid, neardup, packing, quality, registry, sharding, substrings, toxicity
from glyphtrail.llm.common import hash_words
from glyphtrail.llm.components import components, extended

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, id string, rid string, h string"
WORDS = [a + b + c for a in ("ka", "lo", "mi", "re", "su", "ta") for b in ("n", "r", "st", "mm") for c in ("a", "e", "io", "u")]


def text(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", None, "x", "y", "z", "w") for i, t in enumerate(texts)], DOCS)


ODD = [None, "", " ", "é" * 3, text(1, 300), text(1, 300), text(2, 3), text(3, 20_000), text(4, 80)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, a null id, and columns of clashing names."""
    rows = frame(spark, ODD)
    return rows.unionByName(rows.filter("doc_id = 8")).unionByName(rows.filter("doc_id = 8").withColumn("doc_id", F.lit(None).cast("long"))).withColumn("source", F.when(F.col("doc_id") > 3, F.lit("t")))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_words_are_ascii_lower_and_stay_in_their_text():
    texts = ["Ab  cd", "", "x", "ab cd\x0bÄ"]
    raws = [t.encode() for t in texts]
    h, at, _ = hash_words(np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0, *map(len, raws)]))
    assert at.tolist() == [0, 2, 2, 3, 6]
    assert h[0] == h[3] and h[1] == h[4] and len(set(h.tolist())) == 4


def test_sharding(spark, odd, none):
    for docs in (odd, odd.repartition(3)):
        rows = sharding.interleave(docs).collect()
        per = collections.Counter(r["shard"] for r in rows)
        assert len(rows) == 11 and max(per.values()) - min(per[s] for s in range(8)) <= 1
        for s in per:
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(per[s]))
    assert sharding.interleave(none).count() == 0
    many = spark.range(8000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    mix = sharding.interleave(many).groupBy("shard", "stratum").count().collect()
    by = collections.defaultdict(list)
    for r in mix:
        by[r["stratum"]].append(r["count"])
    assert all(len(v) == 8 and max(v) - min(v) <= 3 for v in by.values())


def test_packing_round_trip(spark, odd, none):
    import public_tokenizers
    import zlib
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.encoder()
    for t in ["", "plain words, ok", "naïve ä b　c", "a<|endoftext|>b", " \n\n x  \t", "𝒳 漢字 ١٢", "it's we'll"]:
        assert encode(t).tolist() == exact.encode(t, add_special_tokens=False).ids
    rows = packing.pack(odd).collect()
    places = collections.defaultdict(list)
    for r in rows:
        assert 0 < r["length"] <= 2048
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048
    long = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == 7)
    ids = np.append(np.array(exact.encode(ODD[7], add_special_tokens=False).ids, "<u4"), np.uint32(0)).astype("<u4")
    assert sum(x[2] for x in long) == len(ids) and all(x[2] == 2048 for x in long[1:])
    assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for _, s, n, c in long)
    assert packing.pack(none).count() == 0


def test_bin_completion():
    r = random.Random(3)
    for _ in range(20):
        counts = collections.Counter(r.randint(1, 100) for _ in range(r.randint(1, 300)))
        found = packing.bin_completion(dict(counts), 100)
        held = collections.Counter()
        for filling, copies in found:
            assert sum(filling) <= 100
            for x in filling:
                held[x] += copies
        assert held == counts
        assert sum(n for _, n in found) <= sum(n for _, n in packing.best_fit_decreasing(dict(counts), 100))
    assert sum(n for _, n in packing.bin_completion({60: 10, 40: 10}, 100)) == 10


def fewest_bins(pieces, capacity):
    """The optimum, over all subsets of pieces: bins used and the fullest state of the last one."""
    best = {0: (0, capacity)}
    for mask in range(1, 1 << len(pieces)):
        found = (len(pieces) + 1, 0)
        for i, x in enumerate(pieces):
            if mask >> i & 1:
                bins, used = best[mask ^ 1 << i]
                found = min(found, (bins, used + x) if used + x <= capacity else (bins + 1, x))
        best[mask] = found
    return best[(1 << len(pieces)) - 1][0]


def test_bin_completion_is_optimal_for_few_pieces():
    r = random.Random(8)
    better = 0
    for _ in range(150):
        pieces = [r.choice((r.randint(15, 60), r.randint(25, 40))) for _ in range(r.randint(6, 11))]
        counts = dict(collections.Counter(pieces))
        found = packing.bin_completion(counts, 100)
        assert sum(n for _, n in found) == fewest_bins(pieces, 100)
        assert collections.Counter(x for f, n in found for x in f * n) == collections.Counter(pieces)
        better += sum(n for _, n in found) < sum(n for _, n in packing.best_fit_decreasing(counts, 100))
    assert better >= 3


def test_bin_completion_backtracks_on_histograms():
    r = random.Random(9)
    for _ in range(10):
        counts = {x: r.randint(1, 30) for x in r.sample(range(20, 70), 12)}
        found = packing.bin_completion(counts, 100, 20_000)
        held = collections.Counter()
        for f, n in found:
            assert sum(f) <= 100
            for x in f:
                held[x] += n
        assert held == counts and sum(n for _, n in found) <= sum(n for _, n in packing.best_fit_decreasing(counts, 100))


def test_plain_texts_are_encoded_alike():
    import public_tokenizers
    from tokenizers import Tokenizer

    exact, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder()
    plain = [c for c in map(chr, range(0x2100)) if packing._PLAIN.fullmatch(c)]
    r = random.Random(2)
    samples = [c for c in plain] + [f"a{c}b {c}{c} 1{c}2" for c in plain] + ["".join(r.choice(plain) for _ in range(40)) for _ in range(300)]
    for t in samples:
        assert encode(t).tolist() == exact.encode(t, add_special_tokens=False).ids, t


def test_fingerprints(spark, odd, none):
    docs = odd.filter("doc_id is not null").dropDuplicates(["doc_id"])
    for parts in (1, 3):
        rows = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(docs, parts).collect()}
        assert sorted(rows) == list(range(len(ODD)))
        for i, t in enumerate(ODD):
            t, after = t or "", ODD[(i + 1) % len(ODD)] or ""
            q = len(t) // 4
            assert rows[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest()
            assert rows[i]["n_chars"] == len(t)
        assert rows[4]["fingerprint"] == rows[5]["fingerprint"] and rows[4]["near_next"] == 1
        assert rows[7]["near_edited"] > 0.6 > rows[7]["near_next"]
    assert fingerprints.fingerprint_edits(odd, 3).count() == 11
    assert fingerprints.fingerprint_edits(none, 2).count() == 0
    many = spark.createDataFrame([(i * 7, f"text {i}") for i in range(90)], "doc_id long, text string")
    for parts in (0, 40, 90):
        shas = {x["doc_id"]: x["edited_sha256"] for x in fingerprints.fingerprint_edits(many, parts).collect()}
        assert all(shas[i * 7] == hashlib.sha256((f"text {i}"[: len(f"text {i}") - 1] + "t").encode()).hexdigest() for i in range(90))
    links = {(r["first"], r["doc_id"]) for r in fingerprints.near_pairs(fingerprints.fingerprint(docs)).collect()}
    assert (4, 5) in links and not any(7 in p for p in links)


def test_near_pairs_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(11)
    bits = [rng.integers(0, 2, 256) for _ in range(40)]
    for n in range(160):  # chains of near, unequal fingerprints, just within and just beyond the limit among them
        b = bits[n % 80].copy()
        b[rng.choice(256, (1, 9, 31, 32, 33, 34)[n % 6], replace=False)] ^= 1
        bits.append(b)
    hexes = [np.packbits(b).tobytes().hex() for b in bits]
    # Ids descend within a group, so that the smallest of a band value is none of most pairs.
    prints = spark.createDataFrame([(500 - i, 10, h) for i, h in enumerate(hexes)], "doc_id long, n_chars long, fingerprint string")
    apart = (np.array(bits)[:, None] != np.array(bits)[None]).sum(axis=2)
    want = {(500 - j, 500 - i): 1 - 2 * apart[i, j] / 256 for i in range(200) for j in range(i + 1, 200) if apart[i, j] <= 32}
    assert len(want) > 80
    for members in (2000, 3):
        monkeypatch.setattr(fingerprints, "MEMBERS", members)
        rows = fingerprints.near_pairs(prints).collect()
        assert len(rows) == len(want) and {(r["first"], r["doc_id"]): r["likeness"] for r in rows} == want


def test_one_insertion_changes_few_bits():
    base = fingerprints.code_points(text(9, 400))
    other = np.insert(base, 700, 120)
    a, b = fingerprints.embed([base, other])
    assert fingerprints.likeness(a[None], b[None], np.array([len(base)]), np.array([len(other)]))[0] > 0.5


def brute_groups(texts):
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if x in (a, b) else x for x in group]
    return group, [len(s) for s in sets]


def test_near_duplicates_match_brute_force(spark, odd, none):
    r = random.Random(5)
    texts = list(ODD)
    for k in range(6):
        base = text(100 + k, 120).split()
        for _ in range(12):
            w = list(base)
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = r.choice(WORDS)
            texts.append(" ".join(w))
    group, sizes = brute_groups(texts)
    for docs in (frame(spark, texts), frame(spark, texts).repartition(7)):
        rows = neardup.near_duplicates(docs).orderBy("doc_id").collect()
        assert [x["component_id"] for x in rows] == group
        assert [x["n_shingles"] for x in rows] == sizes
        assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in rows)
    assert neardup.near_duplicates(odd).count() == 11
    assert neardup.near_duplicates(none).count() == 0


def test_one_of_each_group_stays(spark, none):
    a, b, c = text(120, 80), text(121, 80), text(122, 80)
    near = " ".join([*a.split()[:79], "zzz"])
    rows = [(3, a), (5, a), (5, b), (7, c), (7, c), (None, c), (None, near), (9, None), (10, ""), (10, ""), (None, "  ")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, _row int, _Salt string")
    out = neardup.one_of_each(spark, docs, "")
    assert out.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter([(3, a), (5, b), (7, c), (9, None), (10, ""), (10, ""), (None, "  ")])
    found = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in neardup.near_duplicates(docs).collect()}
    assert found[None, 76] in (3, 7) and found[7, 76] == 7
    alone = spark.createDataFrame([(None, a), (None, near)], "doc_id long, text string")
    assert neardup.one_of_each(spark, alone, "").count() == 1
    assert [r["component_id"] for r in neardup.near_duplicates(alone).collect()] == [None, None]
    assert neardup.one_of_each(spark, none, "").count() == 0


def test_signatures_within_reach_share_a_key(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 32, neardup.SLOTS, dtype=np.uint32)
    rows = [(0, base.tobytes())]
    for i in range(1, 60):
        s = base.copy()
        for j in rng.choice(neardup.SLOTS, neardup.REACH, replace=False):
            s[j] += 1 + i
        rows.append((i, s.tobytes()))
    keys = neardup.chunk_keys(spark.createDataFrame([(i, bytearray(s)) for i, s in rows], "id long, signature binary"))
    own = keys.filter("id = 0").select("key")
    assert keys.join(own, "key").select("id").distinct().count() == 60


def test_join_sets_is_exact():
    r = np.random.default_rng(1)
    base = np.arange(60, dtype=np.uint64)
    sets = [np.sort(r.choice(base, 52, replace=False)) for _ in range(40)]
    links = neardup.join_sets(sets, np.arange(40))
    group = list(range(40))
    for x in range(40):
        for y in range(x):
            if neardup.similar(sets[x], sets[y]):
                a, b = group[x], group[y]
                group = [min(a, b) if g in (a, b) else g for g in group]
    own = list(range(40))
    for x, y in links:
        a, b = own[x], own[y]
        own = [min(a, b) if g in (a, b) else g for g in own]
    assert own == group


def brute_cuts(texts):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + 200] for b in raws for i in range(len(b) - 199))
    out = []
    for b in raws:
        cut = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                cut[i : i + 200] = True
        out.append(bytes(np.frombuffer(b, np.uint8)[~cut]))
    return raws, out


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeated_substrings_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    shared, line = text(50, 60), text(51, 40)
    texts = ["a" * 450, "a" * 199, None, "", text(60, 200), text(60, 200), *(f"{text(70 + i, 30)} {shared} {text(90 + i, 30)}" for i in range(6)), (line + "\n") * 4, text(61, 30) + line[:-30], "é" * 150, "é" * 99]
    raws, left = brute_cuts(texts)
    docs = substrings.keyed(frame(spark, texts).select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    rows = {r["rid"]: r for r in substrings.cuts(docs).collect()}
    ids = {r["doc_id"]: r["rid"] for r in docs.collect()}
    for i, (raw, want) in enumerate(zip(raws, left)):
        r = rows.get(ids[i])
        assert (bytes(r["kept"]) if r else raw) == want
        assert (r["n_removed"] if r else 0) == len(raw) - len(want)


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("scope", [1, 3000, 8 << 20])
@pytest.mark.parametrize("waiting", [1, 1 << 18])
def test_substrings_are_the_same_for_every_scope(monkeypatch, hot, scope, waiting):
    monkeypatch.setattr(substrings, "SCOPE", scope)
    monkeypatch.setattr(substrings, "WAITING", waiting)
    monkeypatch.setattr(substrings, "BLOCK", 4000)
    shared = text(50, 80)
    texts = ["a" * 450, text(60, 90), *(f"{text(70 + i, 20)} {shared} {text(90 + i, 20)}" for i in range(9)), text(60, 90), (text(51, 40) + "\n") * 4, shared[:230], "é" * 150]
    raws, left = brute_cuts(texts)
    prints = [substrings.anchors(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[2].view(np.int64).tolist() for b in raws]
    table = pa.table({"rid": pa.array(range(len(texts)), pa.int64()), "text": texts, "live": prints, "hot": prints if hot else [[]] * len(texts)})
    parts = pa.Table.from_batches(b for at in range(0, len(texts), 5) for b in substrings.fragments(iter(table.slice(at, 5).to_batches())))
    spans = collections.defaultdict(list)
    for b in substrings.sort_buckets(iter(parts.sort_by("bucket").to_batches(max_chunksize=7))):
        for rid, found in zip(b.column("rid").to_pylist(), b.column("spans").to_pylist()):
            spans[rid].append(np.frombuffer(found, np.int64).reshape(-1, 2))
    for rid, (raw, want) in enumerate(zip(raws, left)):
        keep = np.ones(len(raw), bool)
        for lo, hi in np.concatenate(spans.get(rid, [np.zeros((0, 2), np.int64)])).tolist():
            keep[lo:hi] = False
        assert bytes(np.frombuffer(raw, np.uint8)[keep]) == want


def test_repeated_rows_and_empty_tables_of_substrings(spark, odd, none):
    out = substrings.without_repeats(spark, odd, "")
    assert out.columns == odd.columns and out.count() == 11
    assert {r["text"] for r in out.filter("doc_id in (4, 5, 8)").collect()} == {""}
    assert substrings.without_repeats(spark, none, "").count() == 0
    clash = odd.withColumn("rid", F.lit(1)).withColumn("spans", F.lit("x")).withColumn("_rid", F.lit(2)).withColumn("_spans", F.lit(3)).withColumn("_text", F.lit(4))
    again = substrings.without_repeats(spark, clash, "")
    assert again.columns == clash.columns and {(r["rid"], r["spans"], r["_rid"], r["_spans"], r["_text"]) for r in again.collect()} == {(1, "x", 2, 3, 4)}


def test_rows_that_share_a_hash_get_ids_of_their_own(spark, monkeypatch):
    plain = F.xxhash64
    docs = spark.createDataFrame([(i % 7, f"t{i % 9}") for i in range(80)] + [(None, "t0"), (None, None), (1, None)], "doc_id long, text string")
    monkeypatch.setattr(substrings.F, "xxhash64", lambda *c: plain(*c) % (20 if len(c) == 2 else 1 << 40))
    rows = docs.withColumn("rid", substrings.row_ids(docs)).distinct().collect()
    assert len({r["rid"] for r in rows}) == len(rows) == 66


def test_contaminated_rows_go_by_row(spark, tmp_path, none):
    item = text(250, 30)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, item), (1, text(251, 50)), (None, item + " more"), (None, text(252, 40)), (2, None), (2, ""), (3, text(253, 9))]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, _row int")
    out = decontamination.drop_contaminated(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter((i, t) for i, t in rows if not (t or "").startswith(item))
    assert decontamination.drop_contaminated(spark, none, str(tmp_path)).count() == 0


def test_cover_joins_any_two_positions():
    assert substrings._SHIFT.shape == (31, 31) and substrings._SHIFT.max() < 31


def test_decontamination(spark, odd, none):
    items = [text(200 + i, n) for i, n in enumerate((4, 15, 17, 25, 40, 59, 90))]
    bench = spark.createDataFrame([*enumerate(items), (98, None), (99, "")], "item_id long, text string")
    w = items[5].split()
    edited = " ".join([*w[:30], "zzz", *w[31:]])
    texts = [text(300, 50) + " " + t.upper() + "\n" + text(301, 50) for t in items] + [f"{text(302, 9)} {edited} {text(303, 9)}", text(304, 500), items[4][: len(items[4]) // 2]]
    rows = decontamination.matches(frame(spark, texts), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(i, i) for i in range(7)} | {(7, 5)}
    assert all(r["similarity"] == pytest.approx(1) and r["start_word"] == 50 for r in rows if r["doc_id"] < 7)
    assert decontamination.matches(odd, bench).count() == 0
    assert decontamination.matches(none, bench).count() == 0
    assert decontamination.matches(odd, spark.createDataFrame([], bench.schema)).count() == 0


def test_contamination_matches_a_search_of_all_starts():
    r = random.Random(31)
    items = [(i, text(700 + i, r.randint(6, 90))) for i in range(14)]
    index = decontamination.build(items)
    docs = []
    for _ in range(100):
        w = r.choice(items)[1].split()
        for _ in range(r.randint(0, 1 + len(w) // 20)):
            at, kind = r.randrange(len(w)), r.randrange(3)
            if kind == 0:
                w[at] = r.choice(WORDS)
            elif kind == 1:
                w[at:at] = [r.choice(WORDS) for _ in range(r.randint(1, 4))]
            else:
                del w[at : at + r.randint(1, 3)]
        docs.append(" ".join([*text(r.random(), r.randint(0, 30)).split(), *w, *text(r.random(), r.randint(0, 30)).split()]))
    raws = [d.encode() for d in docs]
    found = {(t, k): v for t, k, _, v in decontamination.find(index, np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0, *map(len, raws)]))}
    want = {}
    for t, raw in enumerate(raws):
        words, at, _ = hash_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        for k, n in enumerate(index.sizes):
            for s in range(len(words)):
                own = words[s : s + n]
                v = decontamination.similarity(index, k, decontamination.shingle_hashes(own, np.array([0, len(own)]))[0])
                if v >= decontamination.SIMILARITY:
                    want[t, k] = max(v, want.get((t, k), 0))
    assert len(want) > 40
    missed = [x for x in want if x not in found]
    assert not missed and not [x for x in found if x not in want]
    assert all(found[x] == pytest.approx(v) for x, v in want.items())


def test_items_may_have_ids_of_any_type(spark):
    item = text(260, 20)
    for kind in ("string", "int", "decimal(10,0)", "date"):
        bench = spark.createDataFrame([("2020", item)], "item_id string, text string").select(F.col("item_id").cast(kind).alias("item_id"), "text")
        assert decontamination.matches(frame(spark, [item]), bench).count() == 1


def test_decontamination_in_blocks_is_the_same(spark, monkeypatch):
    items = [text(400 + i, 20 + i) for i in range(9)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = frame(spark, [f"{text(500, 20)} {t}" for t in items])
    docs = docs.unionByName(frame(spark, [f"{items[5]} {items[6]}", " ".join(items[8].split()[:20] + ["x"] + items[8].split()[20:])], 20))
    whole = sorted(map(tuple, decontamination.matches(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 60)
    assert sorted(map(tuple, decontamination.matches(docs, bench).collect())) == whole and len(whole) == 11


PAGE = "<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body><header>Site</header><nav><a href=x>Menu</a></nav>{}<div class='comments'><p>Nice!</p></div><form>Mail <input></form><footer>&copy; x</footer></body></html>"


def test_main_text(spark):
    body = "<{0}><h1>Head {1}</h1><p>One &amp; <b>two</b>\n three {1}<br>x<p>Four<div class=ad>Buy</div><p class=note>Same note</p></{0}>"
    pages = [(i, f"http://h{i % 2}/p", PAGE.format(body.format("article" if i % 2 else "div class='post'", i))) for i in range(14)]
    pages += [(50, "http://alone/x", "<p>Only &lt;this&gt;<p>and that"), (51, None, None), (52, "u", ""), (53, "http://h1/", "<html><body><article><p>Cut &am"), (54, "http://h1/", "<article><p>End <a href='")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, text string")
    for size in (html.WRAPPER_BYTES, 0):
        got = {r["page_id"]: r["text"] for r in html.extract(df, size).collect()}
        for i in range(14):
            assert got[i] == f"Head {i}\nOne & two three {i} x\nFour"
        assert (got[50], got[51], got[52], got[53], got[54]) == ("Only <this>\nand that", "", "", "Cut &am", "End")
    assert html.extract(df.limit(0)).count() == 0


def test_copies_and_rare_slots_are_not_template(spark):
    page = "<html><body><article><h1>Title {0}</h1><p>Only {0}</p>{1}</article></body></html>"
    pages = [(i, "http://copies/p", page.format("one", "")) for i in range(60)] + [(60 + i, "http://copies/q", page.format(i, "")) for i in range(4)]
    pages += [(100 + i, "http://big/p", page.format(i, "<blockquote>Said before</blockquote><div class=code>x = 1</div>" if i < 6 else "")) for i in range(40)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "Title one\nOnly one" for i in range(60))
    assert all(got[100 + i] == f"Title {i}\nOnly {i}" + ("\nSaid before\nx = 1" if i < 6 else "") for i in range(40))


def test_the_wrapper_tells_template_from_text_without_names(spark):
    page = "<html><body><div class=q7><p>All rights to us</p></div><div id=k{0}><h1>Weekly report</h1><p>Text of {0}</p><div class=post-{0}><p>More of {0} and {1}</p></div></div><div class=q9><span>There</span></div></body></html>"
    pages = [(i, "http://plain/p", page.format(1000 + i, i * 7)) for i in range(30)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Weekly report\nText of {1000 + i}\nMore of {1000 + i} and {i * 7}" for i in range(30))
    alone = html.main_text(html.parse(pages[3][2]), frozenset(), frozenset())
    assert alone.startswith("All rights to us") and alone.endswith("There")


def test_equal_headlines_and_pages_stay(spark):
    page = "<html><body><nav>Menu</nav><article><h1>Weekly report</h1><p>{}</p></article></body></html>"
    pages = [(i, "http://a/p", page.format("Same")) for i in range(6)] + [(10 + i, "http://b/p", page.format(f"Body {i}")) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "Weekly report\nSame" and got[10 + i] == f"Weekly report\nBody {i}" for i in range(6))


def test_tree_matching():
    a, b = html.tree_of("body\nbody/div.x\nbody/div.x/p\nbody/ul"), html.tree_of("body\nbody/div.y\nbody/div.y/p\nbody/div.y/h1")
    assert html.match(a, b)[0] == 3
    names = {}
    html.align(a, b, "", "", names)
    assert names["body/div.y/p"] == "body/div.x/p" and names["body/div.y/h1"] == "body/div.x/h1"


def test_language_id(spark, odd, none):
    en, de = [text(i, 40) for i in range(40)], ["ß" + text(i, 40).replace("a", "ä").replace("o", "ö") for i in range(40)]
    train = spark.createDataFrame([(i, t, "en" if i < 40 else "de") for i, t in enumerate(en + de)], "doc_id long, text string, lang string")
    langs, matrix = langid.train(train)
    assert langs == ["de", "en"]
    new = spark.createDataFrame([(0, text(900, 30)), (1, text(901, 30).replace("a", "ä").replace("o", "ö")), (2, None), (3, "12 !?"), (4, "")], "doc_id long, text string")
    got = [(r["lang_pred"], 0 <= r["score"] <= 1) for r in langid.predict(new, langs, matrix).collect()]
    assert got == [("en", True), ("de", True), ("und", True), ("und", True), ("und", True)]
    assert langid.predict(odd, langs, matrix).count() == 11
    assert {r["lang_pred"] for r in langid.predict(odd, *langid.train(train.limit(0))).collect()} == {"und"}


def test_toxicity(spark, odd):
    bad = ["vileword", "hateterm", "uglyname"]
    r = random.Random(2)
    sample = []
    for i in range(240):
        w = text(1000 + i, 120).split()
        if i % 3 == 0:
            for _ in range(8):
                w.insert(r.randrange(len(w)), r.choice(bad))
        sample.append((" ".join(w), int(i % 3 == 0)))
    model = toxicity.fit(sample)
    assert all(b.encode() in model.toxic for b in bad)
    docs = spark.createDataFrame([(i, " ".join([*text(2000 + i, 100).split(), *(bad * 3 if i % 2 else [])])) for i in range(20)], "doc_id long, text string")
    got = {x["doc_id"]: x["score"] >= toxicity.THRESHOLD for x in toxicity.score(docs, model).collect()}
    assert sum(got[i] == bool(i % 2) for i in range(20)) >= 18
    assert all(0 <= x["score"] <= 1 for x in toxicity.score(odd, model).collect())
    assert toxicity.score(odd, toxicity.fit([])).count() == 11
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_toxic_roots_of_a_small_language_are_found():
    r = random.Random(4)
    ends = ["ung", "heit", "lich", "en", "er", "st", "te", "sam"]

    def toxic_text(i, root, n, times, few=None):
        w = text(i, n).replace("a", "ö" if few else "a").split()
        for _ in range(times):
            w.insert(r.randrange(len(w)), root + r.choice(ends))
        return " ".join(w)

    def sample(first):
        rows = [(toxic_text(first + i, "blurgha", 100, 5 if i % 5 == 0 else 0), int(i % 5 == 0)) for i in range(400)]
        return rows + [(toxic_text(first + 500 + i, "zwefta", 100, 5 if i % 5 == 0 else i % 5 == 1, True), int(i % 5 == 0)) for i in range(100)]

    train = sample(10_000)
    model = toxicity.fit(train + [train[0]] * 50)  # copies make no contrast
    assert model.weights
    for rows in (sample(20_000)[:400], sample(20_000)[400:]):
        got = [1 / (1 + math.exp(-np.dot(toxicity.features(toxicity.distances(t, model)), model.weights))) >= toxicity.THRESHOLD for t, _ in rows]
        assert sum(g for g, (_, y) in zip(got, rows) if y) >= 0.8 * sum(y for _, y in rows)
        assert sum(g for g, (_, y) in zip(got, rows) if not y) <= 0.02 * len(rows)


def test_labels_are_drawn_once_and_conflicts_left_out(spark):
    docs = frame(spark, [text(8000 + i, 20) for i in range(6)] + [None])
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 1), (1, 1), (2, 0), (3, None), (6, 1), (None, 1)], "doc_id long, toxic int")
    assert sorted(toxicity.draw_sample(docs, labels, "toxic")) == sorted([(text(8001, 20), 1), (text(8002, 20), 0)])
    assert toxicity.draw_sample(docs, labels.limit(0), "toxic") == []


def test_quality(spark, odd, none):
    good = [text(3000 + i, 150) for i in range(160)]
    junk = [" ".join(w.upper() + "###" for w in text(3500 + i, 80).split()) for i in range(6)]
    docs = frame(spark, good + junk)
    trusted = spark.range(0, 120).withColumnRenamed("id", "doc_id")
    rows = {r["doc_id"]: r for r in quality.classify(docs, trusted).collect()}
    assert sum(rows[i]["keep"] for i in range(160)) >= 155
    assert not any(rows[i]["keep"] for i in range(160, 166))
    assert quality.classify(docs, trusted.limit(0)).filter("keep and threshold is null").count() == 166
    assert quality.classify(odd, trusted).count() == 11
    assert quality.classify(odd, trusted).filter("keep and n_symbols = 0").count() == 0
    assert quality.classify(none, trusted).count() == 0


def brute_losses(texts, train, order=quality.ORDER):
    """-log P of each text by an interpolated modified Kneser-Ney model of the texts numbered in ``train``, with dictionaries."""

    def grams(t):
        s = [0] * (order - 1) + quality.symbols(np.array([ord(c) for c in t or ""], np.uint32)).tolist()
        return [tuple(s[i : i + order]) for i in range(len(s) - order + 1)]

    tables = {order: Counter(g for i in train for g in grams(texts[i]))}
    for n in range(order, 1, -1):
        tables[n - 1] = Counter(g[1:] for g in tables[n])
    found = {n: quality.discounts([sum(c == k for c in t.values()) for k in range(1, 5)]) for n, t in tables.items()}
    totals, cuts = collections.defaultdict(int), collections.defaultdict(float)
    for n, t in tables.items():
        for g, c in t.items():
            totals[n, g[:-1]] += c
            cuts[n, g[:-1]] += found[n][min(c, 3) - 1]

    def p(g):
        n = len(g)
        low = p(g[1:]) if n > 1 else 1 / (1 << quality.BITS)
        if not totals.get((n, g[:-1])):
            return low
        c = tables[n].get(g, 0)
        return (max(0, c - found[n][min(c, 3) - 1]) if c else 0) / totals[n, g[:-1]] + cuts[n, g[:-1]] / totals[n, g[:-1]] * low

    return [-sum(math.log(p(g)) for g in grams(t)) for t in texts]


@pytest.mark.parametrize("chunk, share", [(16 << 20, 1 << 21), (900, 3)])
def test_losses_match_brute_force(spark, monkeypatch, chunk, share):
    texts = [text(6500 + i, 60) + (" ünseen\n слово 漢字" if i % 3 == 0 else "") for i in range(14)] + ["", "  ", None, "alone", "Ω!"]
    monkeypatch.setattr(quality, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(quality, "SHARE", share)
    monkeypatch.setattr(quality, "PACK_BYTES", chunk)
    docs = frame(spark, texts).unionByName(frame(spark, [texts[3]]).withColumn("doc_id", F.lit(None).cast("long")))
    trusted = spark.createDataFrame([(i, i % 4 == 0) for i in (0, 1, 2, 3, 4, 5, 6, 7, 16, 99)], "doc_id long, held boolean")
    rows = {r["doc_id"]: r for r in quality.score(docs, trusted, ["doc_id", "lang"]).collect()}
    want = brute_losses(texts, [1, 2, 3, 5, 6, 7])
    assert len(rows) == len(texts) + 1
    for i, t in enumerate(texts):
        assert rows[i]["n_symbols"] == len(t or "") and rows[i]["loss"] == pytest.approx(want[i], rel=1e-5, abs=1e-6)
        assert (rows[i]["trusted"], rows[i]["held"]) == (i in range(8) or i == 16, i in (0, 4, 16))
    assert rows[None]["loss"] == pytest.approx(want[3], rel=1e-5) and not rows[None]["trusted"]
    docs = frame(spark, [" "] * 3)
    assert quality.score(docs, trusted.limit(0), ["doc_id", "lang"]) is None


def test_probabilities_sum_to_one(spark):
    symbols = sorted(set(quality.symbols(np.array([ord(c) for c in text(1, 50)], np.uint32)).tolist()))
    keys, _ = quality.ngrams(np.frombuffer((t := text(1, 50)).encode(), np.uint8), np.array([0, len(t)]))
    seen = Counter(keys.tolist())
    context = max(seen, key=seen.get) >> quality.BITS << quality.BITS
    rows = [(0, int(context | s), seen.get(int(context | s), 0)) for s in range(1 << quality.BITS)] + [(0, k, c) for k, c in seen.items() if k >> quality.BITS != context >> quality.BITS]
    found = quality.probabilities(spark.createDataFrame(rows, "shard long, k long, c long")).filter(F.shiftright("k", quality.BITS) == context >> quality.BITS)
    assert found.agg(F.sum("p")).first()[0] == pytest.approx(1, abs=1e-9) and len(symbols) > 5


def test_words_in_a_bad_order_are_not_kept(spark):
    def ordered(seed, n):
        r, w = random.Random(seed), random.Random(seed).randrange(len(WORDS))
        out = []
        for _ in range(n):
            out.append(WORDS[w])
            w = (5 * w + r.choice((1, 7))) % len(WORDS)
        return out

    good = [ordered(6000 + i, 150) for i in range(160)]
    junk = [random.Random(i).sample(g, len(g)) for i, g in enumerate(good[140:146])]
    docs = frame(spark, [" ".join(t) for t in good + junk])
    rows = {r["doc_id"]: r["keep"] for r in quality.classify(docs, spark.range(0, 120).withColumnRenamed("id", "doc_id")).collect()}
    assert sum(rows[i] for i in range(160)) >= 155 and not any(rows[i] for i in range(160, 166))


def test_thresholds_are_quantiles_of_held_out_trusted_text(spark):
    docs = frame(spark, [text(6800 + i, 40 + i % 60) for i in range(160)]).withColumn("lang", F.when(F.col("doc_id") >= 150, "xx").otherwise("en"))
    rows = quality.classify(docs, spark.range(0, 155).withColumnRenamed("id", "doc_id")).collect()
    held = sorted(r["shrunk_loss"] for r in rows if r["held_out"] and r["lang"] == "en")
    every = sorted(r["shrunk_loss"] for r in rows if r["held_out"])
    assert len(held) >= quality.LEAST_HELD and all(r["trusted"] for r in rows if r["held_out"])
    for lang, losses in (("en", held), ("xx", every)):
        median, high = losses[math.ceil(0.5 * len(losses)) - 1], losses[math.ceil(0.99 * len(losses)) - 1]
        assert all(r["threshold"] == pytest.approx(high + (1 - 0.01 * len(losses)) * (high - median)) for r in rows if r["lang"] == lang)
    assert all(r["keep"] == (r["shrunk_loss"] <= r["threshold"]) for r in rows)


def test_keep_good_decides_by_row(spark, tmp_path, odd, none):
    spark.range(0, 100).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality")).write.parquet(str(tmp_path / "labels.parquet"))
    good, junk = [text(7000 + i, 100) for i in range(120)], " ".join(w.upper() + "###" for w in text(7500, 80).split())
    rows = frame(spark, good).withColumn("_row", F.lit(5))
    more = spark.createDataFrame([(110, junk), (None, junk), (None, good[3]), (115, good[115]), (115, None)], "doc_id long, text string")
    docs = rows.unionByName(more, allowMissingColumns=True)
    out = quality.keep_good(spark, docs, str(tmp_path))
    kept = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert out.columns == docs.columns
    assert not any(t == junk or t is None for _, t in kept) and kept[110, good[110]] == 1 and kept[None, good[3]] == 1 and kept[115, good[115]] == 2
    assert quality.keep_good(spark, none, str(tmp_path)).count() == 0


CONTRACTS = {
    "op1_quality": {"doc_id": "bigint", "perplexity": "double", "threshold": "double", "keep": "boolean"},
    "op2_interleaved_shards": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op3_decontamination": {"doc_id": "bigint", "item_id": "bigint", "similarity": "double"},
    "op4_main_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op5_repeated_substrings": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op6_near_duplicates": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op7_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op9_packed_sequences": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op10_edit_fingerprints": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    r = random.Random(12)
    shared = text(8100, 45)
    texts = [text(8200 + i, 30 + i % 50) for i in range(60)] + [f"{text(8300 + i, 20)} {shared}" for i in range(5)] + [text(8200, 30)] * 3 + ["", " ", "ÄÖ ü " * 3]
    near = text(8205, 35).split()
    texts += [" ".join([*near[:j], "zzz", *near[j + 1 :]]) for j in (3, 34)]
    rows = [(i, t, r.choice(("en", "de")), r.choice(("a", "a", "b")), len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 9 > 0), int(i % 7 == 0)) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    spark.createDataFrame([(0, " ".join(texts[9].split()[5:30]))], "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    spark.createDataFrame([(i, f"http://h{i % 2}/p", f"<article><h1>T {i}</h1><p>Body {i}</p></article>") for i in range(9)], "page_id long, url string, html string").write.parquet(str(at / "pages.parquet"))
    return str(at)


@pytest.mark.parametrize("name", list(CONTRACTS))
def test_registered_queries_keep_their_contract(spark, tables, name):
    import duckdb

    out = registry.QUERIES[name](spark, tables)
    kinds = dict(out.dtypes)
    assert {c: kinds.get(c) for c in CONTRACTS[name]} == CONTRACTS[name]
    rows = [tuple(r[c] for c in sorted(out.columns)) for r in out.collect()]
    if name != "op3_decontamination":
        assert {r[sorted(out.columns).index("page_id" if name == "op4_main_text" else "doc_id")] for r in rows} == set(range(9 if name == "op4_main_text" else 73))
    if name in registry.ORACLES:
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tables}/documents.parquet/*.parquet'")
        found = con.execute(registry.ORACLES[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(out.columns)
        want = [tuple(r[names.index(c)] for c in sorted(names)) for r in found.fetchall()]
        assert Counter(map(repr, rows)) == Counter(map(repr, want))


def test_held_out_languages(spark):
    held = [(10_000 + i, text(20_000 + i, 60).replace("a", "ä") if i % 2 else text(20_000 + i, 60), "de" if i % 2 else "en") for i in range(200)]
    docs = spark.createDataFrame([(i, t, k) for i, t, k in held], "doc_id long, text string, lang string")
    model = langid.train(docs.filter("doc_id % 4 <> 2"))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs.filter("doc_id % 4 = 2"), *model).collect()}
    assert len(got) == 50 and sum(got[i] == k for i, _, k in held if i in got) >= 49


def test_pipeline_stages_keep_the_columns(spark, tmp_path):
    import corpus_pipeline

    docs = frame(spark, [text(5000 + i, 150) for i in range(40)] + [text(5000, 150)]).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(0, 30).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, " ".join(text(5003, 150).split()[20:60]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    kept = {r["doc_id"] for r in out.collect()}
    assert 3 not in kept and 40 not in kept and len(kept) >= 36
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_substrings", "decontamination", "packing"]


@pytest.mark.parametrize("size", [0, 60])
def test_components_match_union_find(spark, size):
    rng = np.random.default_rng(3)
    edges = [(int(x), int(y)) for x, y in rng.integers(0, 80, (size, 2)) if x != y] + [(100 + k, 101 + k) for k in range(12 if size else 0)]
    old, new = edges[: len(edges) // 2], edges[len(edges) // 2 :]
    schema = "a long, b long"

    def least(links):
        root = {x: x for link in links for x in link}
        for _ in root:
            for x, y in links:
                root[x] = root[y] = min(root[x], root[y])
        return root

    found = components(spark.createDataFrame(edges + edges, schema))
    assert sorted(map(tuple, found.collect())) == sorted(least(edges).items())
    grown = extended(components(spark.createDataFrame(old, schema)), spark.createDataFrame(new, schema))
    assert sorted(map(tuple, grown.collect())) == sorted(least(edges).items())
