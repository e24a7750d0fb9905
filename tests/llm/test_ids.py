"""Sharding, mixing, SimHash, sketches and packing against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash

from cairnlog.llm import graph, mixing, packing, sharding, simhash, sketch

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("kind", ["docs", "odd_docs", "no_docs"])
def test_sharding(request, kind):
    docs = request.getfixturevalue(kind)
    got = rows(sharding.shard_documents(docs, [1.0] * 8))
    texts = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == texts
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len({r["shard"] for r in got if r["doc_id"] == d}) == 1 for d, *_ in texts)


def test_slots_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 10)
    docs = spark.createDataFrame([(7, "x")] * 400 + [(None, "y")] * 300 + [(i, "z") for i in range(100)], "doc_id long, text string")
    got = rows(sharding.shard_documents(docs, [1.0, 1.0]))
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert len(got) == 800 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_weights(spark):
    ids = spark.range(20000).withColumnRenamed("id", "doc_id").selectExpr("doc_id", "'x' text")
    got = Counter(r["shard"] for r in sharding.shard_documents(ids, [1.0, 1.0, 2.0]).select("shard").collect())
    assert abs(got[2] / 20000 - 0.5) < 0.02 and abs(got[0] / 20000 - 0.25) < 0.02
    moved = sharding.shard_documents(ids, [1.0] * 4).where("grown_shard <> shard").count()
    assert abs(moved / 20000 - 0.2) < 0.02


@pytest.mark.parametrize("kind", ["docs", "odd_docs", "no_docs"])
def test_mixing(request, kind):
    docs = request.getfixturevalue(kind)
    got = rows(mixing.plan(docs, block_rows=8))
    size = Counter()
    tokens = defaultdict(set)
    for r in docs.collect():
        n = max(1, len([w for w in re.split(r"[ \t\n\x0b\f\r]+", r.text or "") if w]))
        size[r.source] += n
        tokens[r.doc_id, r.source].add(n)
    if not size:
        assert not got
        return
    alpha = got[0]["alpha"]
    total = sum(v**alpha for v in size.values())
    weight = {s: v**alpha / total for s, v in size.items()}
    budget = max(size[s] / weight[s] for s in size)
    reads = {s: weight[s] * budget / size[s] for s in size}
    assert min(reads.values()) >= 1 - 1e-9 and max(reads.values()) <= mixing.MAX_REPEATS + 1e-6
    assert {(r["doc_id"], r["source"]) for r in got} == set(tokens)
    read = Counter()
    for r in got:
        assert abs(r["weight"] - weight[r["source"]]) < 1e-9
        assert r["tokens"] in tokens[r["doc_id"], r["source"]] and 0 <= r["mix_order"] < 1
        read[r["source"]] += r["tokens"]
    blocks = {s: len({r["block"] for r in got if r["source"] == s}) for s in size}
    most = {s: max(r["tokens"] for r in got if r["source"] == s) for s in size}
    for s in size:  # up to the document that reaches each block's budget
        assert weight[s] * budget - 1e-6 <= read[s] <= weight[s] * budget + blocks[s] * most[s] + 1e-6


def test_mixing_targets(spark):
    sizes = spark.createDataFrame([(f"s{i}", 10**i) for i in range(6)], "source string, _mix_tokens long")
    share = np.array([10.0**i for i in range(6)])
    target = 1.2
    a = mixing.exponent(sizes, target, None)
    p = share**a / (share**a).sum()
    assert abs(-(p * np.log(p)).sum() - target) < 1e-4
    a = mixing.exponent(sizes, None, 4.0)
    assert abs((share.max() / share.min()) ** (1 - a) - 4.0) < 1e-3
    assert mixing.exponent(sizes, 99.0, None) < 1e-8 and mixing.exponent(sizes, None, None) == 1.0
    assert mixing.exponent(sizes, 0.0, None) > 1 - 1e-8


def test_mixed_keeps_rows(odd_docs, no_docs):
    clash = odd_docs.withColumnsRenamed({"seg": "_row", "root": "_mix_n", "h": "_mix_row"})
    got = mixing.mixed(clash)
    assert got.columns == clash.columns and mixing.mixed(no_docs).count() == 0
    have, want = Counter(map(str, got.collect())), Counter(map(str, clash.collect()))
    assert have.keys() == want.keys() and all(want[r] <= have[r] <= 2 * want[r] for r in want)


@pytest.mark.parametrize("budget", [None, 700.0, 50.0])
def test_mixed_counts_each_row(spark, monkeypatch, budget):
    """Repeated rows and null ids are read as often as any other, and a hot id is split."""
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 4)
    monkeypatch.setattr(mixing, "HOT", 2)
    rows = [(1, "x y", "a")] * 100 + [(None, "x", "a")] * 50 + [(None, f"x {i}", None) for i in range(30)] + [(i, "w", "b") for i in range(200)] + [(7, f"v {i} z", "c") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    got = mixing.mixed(docs, repeats=4.0, budget=budget).collect()
    alpha = mixing.exponent(spark.createDataFrame([(s, n) for s, n in size.items()], "source string, _mix_tokens long"), None, 4.0)
    z = sum(n**alpha for n in size.values())
    total = budget or max(n / (n**alpha / z) for n in size.values())
    read, own = Counter(), Counter((r, s) for r, _, s in rows)
    for r in got:
        read[r.source] += len(r.text.split())
    for s, n in size.items():
        due, rows_of = n**alpha / z * total, sum(x[2] == s for x in rows)
        assert due - 1e-6 <= read[s] <= due + 3 * (rows_of + 1)
        if budget is None:
            assert {(r.doc_id, r.source) for r in got} == own.keys()
    assert sum(read.values()) <= total + 3 * len(rows) / 2  # a document beyond each block's budget at most
    planned = mixing.plan(docs, repeats=4.0, budget=budget, block_rows=4)
    assert abs(planned.count() - len(got)) < 40


def brute_fingerprint(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode()) if w]
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    least = list(range(len(ids)))
    root = lambda i: i if least[i] == i else root(least[i])
    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                least[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(ids)):
        groups[root(i)].append(ids[i])
    return [min((x for x in groups[root(i)] if x is not None), default=None) for i in range(len(ids))]


@pytest.mark.parametrize("kind", ["docs", "odd_docs", "no_docs"])
def test_simhash(request, kind):
    docs = request.getfixturevalue(kind)
    own = docs.collect()
    fps = [brute_fingerprint(r.text) for r in own]
    comp = brute_components([r.doc_id for r in own], fps)
    want = Counter((r.doc_id, f"{f:016x}", c) for r, f, c in zip(own, fps, comp))
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hexed("fp").alias("f"), "component_id")
    assert Counter(map(tuple, got.collect())) == want
    kept = simhash.one_of_each(docs.withColumnRenamed("lang", "_n"))
    assert kept.columns == docs.withColumnRenamed("lang", "_n").columns
    groups = brute_components(list(range(len(own))), fps)
    heads = {}
    for i, g in enumerate(groups):
        heads.setdefault(g, set()).add(own[i].doc_id)
    least = Counter(min((d for d in ids if d is not None), default=None) for ids in heads.values())
    assert Counter(r.doc_id for r in kept.collect()) == least


def test_one_of_each_loses_no_group(spark):
    a, b, c = ("one two three four five six " * 9, "red blue green yellow pink black " * 9, "up down left right front back " * 9)
    rows = [(None, a), (None, b), (None, b), (5, a), (5, c), (5, c), (7, c.upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, simhash.one_of_each(docs).collect())) == Counter([(5, a), (None, b), (5, c)])


@pytest.mark.parametrize("n", [10, 10**5, 10**8, 10**12])
def test_segments_for(n):
    for bits in (0, 1, 3, 4, 7):
        found = simhash.segments_for(n, bits)
        assert sum(t + 1 for _, _, t in found) == bits + 1 and sum(w for _, w, _ in found) == 64
        assert [i for i, _, _ in found] == [sum(w for _, w, _ in found[:k]) for k in range(len(found))]
    assert len(simhash.segments_for(10**10)) < len(simhash.segments_for(10**5))


def test_simhash_links_random(spark):
    """Dense clusters and chains of fingerprints, against all pairs."""
    rnd = random.Random(3)
    fps = set()
    for _ in range(25):
        f = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 2, 30])):
            fps.add(f)
            for b in rnd.sample(range(64), rnd.choice([1, 2, 4, 5, 8])):
                f ^= 1 << b
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    some = spark.createDataFrame([(f, 1) for f in signed], "fp long, n long")
    got = dict(simhash.links(some).collect())
    want = brute_components(signed, fps)
    assert len(got) == len(fps) and got == dict(simhash.links(some, segments=simhash.segments_for(10**10)).collect())
    pairs = defaultdict(set)
    for f, w in zip(signed, want):
        pairs[w].add(got[f])
    assert all(len(x) == 1 for x in pairs.values()) and len(set(got.values())) == len(pairs)


@pytest.mark.parametrize("rows", [graph.BROADCAST_ROWS, 20])
def test_components(spark, monkeypatch, rows):
    monkeypatch.setattr(graph, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(graph, "HOT_ROWS", 50)
    chain = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(7, 7)]
    got = dict(graph.components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert len({got[i] for i in range(201)}) == 1 and len({got[i] for i in range(1000, 1300)}) == 1
    assert len(set(got.values())) == 2 and all(got[v] == v for v in got.values())
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("kind", ["docs", "odd_docs", "no_docs"])
def test_edited(request, kind):
    docs = request.getfixturevalue(kind)
    hashed = docs.selectExpr("doc_id", "coalesce(text, '') text", "xxhash64(coalesce(text, '')) h").collect()
    own = [(r.doc_id, r.text) for r in sorted(hashed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))]
    want, near = Counter(), defaultdict(list)
    for i, (d, t) in enumerate(own):
        after = own[(i + 1) % len(own)][1]
        new = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        grams = [set(simhash.shingle_hashes(x, 5).tolist()) for x in (t, new, after)]
        like = [len(grams[0] & g) / len(grams[0] | g) if grams[0] | g else 1.0 for g in grams[1:]]
        want[d, len(t), hashlib.sha256(new.encode()).hexdigest()] += 1
        near[d, len(t)].append(like)
    got = rows(sketch.edited(docs))
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    errors = []
    for r in got:
        likes = near[r["doc_id"], r["n_chars"]]
        errors.append(min(abs(r["near_edited"] - n[0]) + abs(r["near_next"] - n[1]) for n in likes))
    assert not errors or (max(errors) < 0.2 and np.mean(errors) < 0.03)


@pytest.mark.parametrize("kind", ["int", "string", "decimal(20,2)", "date"])
def test_edited_ids_of_any_type(spark, kind):
    """Any id that has an order; rows of one id, equal ones too, are in several ranges, and each has one next."""
    made = {"int": "id", "string": "concat('k', lpad(id, 3, '0'))", "decimal(20,2)": "id + 0.25", "date": "date_add(DATE'2020-01-01', CAST(id AS INT))"}[kind]
    ids = spark.range(60).selectExpr(f"CAST({made} AS {kind}) AS doc_id", "concat('text of ', id, ' and more') AS text")
    hot = spark.range(300).selectExpr(f"CAST({made.replace('id', '30')} AS {kind}) AS doc_id", "if(id < 200, 'same', concat('other ', id)) AS text")
    docs = ids.unionByName(hot).repartition(4)
    got = sketch.edited(docs)
    assert got.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    out = got.collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in docs.collect())
    hashed = docs.selectExpr("doc_id", "text", "xxhash64(text) h").collect()
    own = [(r.doc_id, r.text) for r in sorted(hashed, key=lambda r: (r.doc_id, r.h))]
    want = Counter()
    for i, (d, t) in enumerate(own):
        after = own[(i + 1) % len(own)][1]
        want[d, hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in out) == want


def test_sketch_parts():
    rnd = random.Random(1)
    words = [rnd.choice("abcdefghij") + str(rnd.randrange(900)) for _ in range(6000)]
    a, b = " ".join(words[:4000]), " ".join(words[2000:])
    sets = [set(simhash.shingle_hashes(x, 5).tolist()) for x in (a, b)]
    sa, sb = sketch.sketch(a), sketch.sketch(b)
    assert sorted(sets[0])[:128] == sa.tolist() and sorted(sets[0] | sets[1])[:128] == sketch.merge(sa, sb).tolist()
    assert abs(sketch.resemblance(sa, sb) - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 0.15
    assert abs(sketch.containment(sa, sb) - 0.5) < 0.2 and abs(sketch.distinct(sa) / len(sets[0]) - 1) < 0.3
    assert sketch.unpacked(sketch.packed(sa)).tolist() == sa.tolist()
    again = sketch.sketch("x y z " * 5000)
    assert len(again) == 3


def test_tokens_equal_the_tokenizers(docs, odd_docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    texts = [r.text for r in docs.union(odd_docs.select(*docs.columns)).collect() if r.text is not None]
    texts += ["don't we'll it's I'M 12ab--c_d «x» ¼ ÀÉ", "".join(map(chr, range(32, 0x260))), " ".join(map(chr, range(1, 0x3000)))]
    cut = packing.ChunkTokenizer(TOKENIZER, keep=500)
    for part in (texts[:50], texts[50:], texts):
        for text, ids in zip(part, cut.ids(part)):
            assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text[:50]


@pytest.mark.parametrize("kind", ["docs", "odd_docs", "no_docs"])
def test_packing(request, kind):
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(kind)
    t = Tokenizer.from_file(TOKENIZER)
    got = rows(packing.pack(docs, TOKENIZER, capacity=1024))
    want = Counter()
    for r in docs.collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 1024):
            want[r.doc_id, k // 1024, k, len(ids[k : k + 1024]), zlib.crc32(ids[k : k + 1024].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= math.ceil(sum(r["length"] for r in got) / 1024) * 1.05 + 1


def bins(counts, plan, capacity):
    """How many sequences a plan has, if it places every piece once."""
    placed = Counter()
    for lengths, times in plan:
        assert sum(lengths) <= capacity and times > 0
        for x in lengths:
            placed[x] += times
    assert placed == counts
    return sum(n for _, n in plan)


def fewest(items, capacity):
    """Brute force: each piece into every open bin that it fits, or a new one."""
    best = [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= items[i]}.values():
            go(i + 1, [*rooms[:j], rooms[j] - items[i], *rooms[j + 1 :]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


def test_plan_is_exact():
    rnd = random.Random(1)
    for _ in range(150):
        capacity = rnd.choice([20, 50, 100])
        low, high = rnd.choice([(1, capacity), (max(1, capacity // 5), capacity // 2)])
        items = sorted((rnd.randint(low, high) for _ in range(rnd.randint(1, 11))), reverse=True)
        counts, least = Counter(items), fewest(items, capacity)
        assert bins(counts, packing.plan(counts, capacity, None), capacity) == least
        assert packing.least_bins(counts, capacity) <= least <= bins(counts, packing.best_fit(counts, capacity), capacity)


def test_plan_of_triplets():
    """Twenty full sequences of three pieces each, which best-fit decreasing doesn't find."""
    rnd = random.Random(0)
    items = []
    for _ in range(20):
        a = rnd.randint(380, 470)
        b = rnd.randint(255, (1000 - a) // 2)
        items += [a, b, 1000 - a - b]
    counts = Counter(items)
    assert bins(counts, packing.plan(counts, 1000), 1000) == 20 < bins(counts, packing.best_fit(counts, 1000), 1000)


def test_plan_is_never_above_best_fit():
    rnd = random.Random(7)
    for n, low, high in ((400, 1000, 2200), (900, 5, 4096), (300, 1300, 1400)):
        counts = Counter(rnd.randint(low, high) for _ in range(n))
        decreasing = bins(counts, packing.best_fit(counts, 4096), 4096)
        rooms = []  # the textbook's way, a piece at a time
        for x in sorted(counts.elements(), reverse=True):
            at = min((i for i, r in enumerate(rooms) if r >= x), key=lambda i: rooms[i], default=None)
            if at is None:
                rooms.append(4096 - x)
            else:
                rooms[at] -= x
        assert decreasing == len(rooms) >= bins(counts, packing.plan(counts, 4096, 100_000), 4096)


def test_fillings_are_undominated():
    left = {2: 1, 3: 2, 5: 1, 7: 1}
    assert list(packing.fillings(left, 8, 0)) == [(5, 3)]  # 3 + 3 + 2 is as full, but 5 stands for 3 + 2
    every = [f for w in range(9) for f in packing.fillings(left, 8, w)]
    assert every[0] == (5, 3) and (7,) in every and (3, 3) not in every


def test_plan_finds_full_bins():
    rnd = random.Random(5)
    counts = Counter()
    for _ in range(300):  # bins of exactly 100, cut at random
        cuts = sorted(rnd.sample(range(1, 100), 3))
        for a, b in zip([0, *cuts], [*cuts, 100]):
            counts[b - a] += 1
    assert bins(counts, packing.plan(counts, 100), 100) <= 302
    assert packing.plan({}, 100) == [] and sorted(packing.plan({1: 250}, 100)) == [((1,) * 50, 1), ((1,) * 100, 2)]
    with pytest.raises(ValueError):
        packing.plan({101: 1}, 100)
