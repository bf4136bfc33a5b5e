"""Sharding, URL filter, top-k, mixing, fingerprints, SimHash: SQL twins, brute force, edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cohortlens.llm import common, merkle, mixing, sharding, simhash, topk, urls
from cohortlens.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
PAGES = "page_id bigint, url string, html string"


# sharding


def check_shards(rows, shards):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(by) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_sharding_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op1_sharding"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    check_shards(got, 40)
    groups = defaultdict(set)
    for r in got:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        groups[texts[r["doc_id"]]].add(r["shard"])
    whole = Counter(texts.values())
    assert all(len(s) == 1 for t, s in groups.items() if whole[t] <= len(texts) // 40)


@pytest.mark.parametrize("copies,shards", [(300, 10), (40, 7), (0, 3)])
def test_sharding_hot_group(spark, copies, shards):
    rows = [(i, "same") for i in range(copies)] + [(1000 + i, f"t{i // 2}") for i in range(400)] + [(5000 + i, f"own {i}") for i in range(201)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sharding.assign(docs, shards).collect()
    assert len(got) == len(rows)
    check_shards(got, shards)
    text = dict(rows)
    spread = defaultdict(set)
    for r in got:
        spread[text[r["doc_id"]]].add(r["shard"])
    # a pair may be cut only where a quota ends, and the hot group leaves shards that it began in
    assert sum(len(s) > 1 for t, s in spread.items() if t != "same") <= 2 * shards
    if copies:
        assert math.ceil(copies / (len(rows) / shards)) <= len(spread["same"]) <= shards - 1


def test_sharding_edge_cases(edge_docs, no_docs):
    got = sharding.assign(edge_docs, 4).collect()
    assert len(got) == edge_docs.count()
    check_shards(got, 4)
    null = [r for r in got if r["doc_id"] == 3][0]
    assert (null["size"], null["text_crc32"]) == (16, None)
    assert sharding.assign(no_docs, 4).count() == 0


# URL filter


@pytest.fixture(scope="module")
def pages(spark):
    made = [f"http://h{i % 3}.example.org/{'en' if i % 2 else 'de'}/{i}.html" for i in range(60)]
    made += [f"https://shop.net/{a}/{i}" for a in ("es", "fr", "en", "it") for i in range(10)]
    made += [f"https://x.example.com/en/{i}" for i in range(9)] + [f"http://www.example.com/en/p{i}/q" for i in range(7)]
    made += [None, "", "no scheme/at/all", "http://", "HTTP://EXAMPLE.com", "http://Ä.Com/en/?a", "ftp://com/x", "http://notcom/en/", "http://a.b.net/es/1?q#f", "http://a.net/es", "x://y://z/w", "http://com", "http://a.com?x/y", "http://a.com#/en/", "http://k.com//", "http://k.com/a/b/c/d/e/1", "http://k.com/a/b//", "http://k.org/" + "s" * 5000]
    rows = [(i, u, None) for i, u in enumerate(made)] + [(None, "http://a.net/fr/", "x"), (3, made[3], "x")]
    return spark.createDataFrame(rows, PAGES).withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1)).withColumn("node", F.lit(1))


def test_urls_equal_sql(spark, pages, parity):
    assert parity(urls.judge(pages), ORACLES["op2_url_filter"], pages=pages.select("page_id", "url")) == pages.count()
    assert parity(QUERIES["op2_url_filter"](spark, SF), ORACLES["op2_url_filter"], pages=f"{SF}/pages.parquet") > 0


def test_urls_rules_and_templates(pages):
    got = {(r["page_id"]): r for r in urls.judge(pages).collect()}
    by = {r["url"]: got[r["page_id"]] for r in pages.filter("page_id IS NOT NULL").collect()}
    assert (by[None]["host"], by[None]["path"], by[None]["rule"]) == ("", "", None)
    assert by["HTTP://EXAMPLE.com"]["host"] == "example.com" and by["HTTP://EXAMPLE.com"]["rule"] is None
    assert (by["https://x.example.com/en/1"]["rule"], by["https://x.example.com/en/1"]["verdict"]) == ("example.com/en/", "block")
    assert (by["http://www.example.com/en/p1/q"]["rule"], by["http://www.example.com/en/p1/q"]["verdict"]) == ("www.example.com/en/", "allow")
    assert by["http://a.net/es"]["rule"] is None and by["http://notcom/en/"]["rule"] is None
    # branches of shop.net are alike, and what is labelled there is blocked
    assert by["https://shop.net/it/3"]["rule"] is None and by["https://shop.net/it/3"]["verdict"] == "block"


def test_urls_empty(spark):
    assert urls.judge(spark.createDataFrame([], PAGES)).count() == 0


def judged(spark, parity, pages, rules=None):
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(pages)], PAGES)
    if rules is None:
        assert parity(urls.judge(df), ORACLES["op2_url_filter"], pages=df.select("page_id", "url")) == len(pages)
    return {r["page_id"]: r["verdict"] for r in urls.judge(df, rules or urls.RULES).collect()}


def test_url_sections_of_a_large_host_stay_apart(spark, parity):
    """Twenty even sections of distinct pages, one of them ruled out: only that one is blocked."""

    slug = lambda i: "p" + "abcdefghij"[i // 10] + "abcdefghij"[i % 10]
    section = lambda k: "es" if k == 0 else "s" + "abcdefghijklmnopqrst"[k]
    pages = [f"http://big.net/{section(k)}/{slug(i)}" for k in range(20) for i in range(60)]
    pages += [f"http://fine.com/{section(k)}/{slug(i)}" for k in range(1, 10) for i in range(20)]
    got = judged(spark, parity, pages)
    assert {got[i] for i in range(60)} == {"block"} and {got[i] for i in range(60, 1200)} == {"allow"}


def test_url_templates_below_the_second_level(spark, parity):
    """/a/b/<slug>/spam and /a/b/<slug>/review are templates of their own, on any host."""

    slug = lambda i: "q" + "abcdefghijklmnopqrstuvwxyz"[i % 26] + "xyzuvw"[i // 26]
    rules = (("bad.org", "/", "block"), ("good.org", "/", "allow"))
    pages = [f"http://bad.org/a/b/{slug(i)}/spam" for i in range(60)] + [f"http://good.org/a/b/{slug(i)}/review" for i in range(60)]
    pages += [f"http://other.net/a/b/{slug(i)}/{'spam' if i % 2 else 'review'}" for i in range(80)]
    got = judged(spark, parity, pages, rules)
    assert all(got[120 + i] == ("block" if i % 2 else "allow") for i in range(80))
    deep = ["http://deep.com/" + "/".join("abcdefgh"[: 1 + i % 8]) + f"/{'yz'[i % 2]}" for i in range(160)] + ["http://x.net/" + "/".join(f"s{'abc'[i % 3]}" for i in range(40))]
    judged(spark, parity, deep)


def test_url_branches_of_unlike_purity_are_not_merged(spark, parity):
    """Two sections with the same pages, one blocked and one allowed, and a third without labels like neither's pages."""

    rules = (("host.org", "/bad/", "block"), ("host.org", "/good/", "allow"))
    pages = [f"http://host.org/{k}/list/{i % 7}" for k in ("bad", "good", "new") for i in range(30)]
    got = judged(spark, parity, pages, rules)
    assert {got[i] for i in range(30)} == {"block"} and {got[i] for i in range(30, 60)} == {"allow"}



# top-k


def test_topk_equals_sql(spark, parity):
    assert parity(QUERIES["op4_topk"](spark, SF), ORACLES["op4_topk"], embeddings=f"{SF}/embeddings.parquet") > 0


def test_topk_edge_cases_and_blocks(spark, parity):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 5) / 64]) for i in range(130)]
    rows += [(200, None), (220, [1.0, None, 0.0, 0.0, 0.0]), (240, [float("nan"), 0.0, 0.0, 0.0, 0.0]), (260, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (20, rows[20][1]), (None, rows[0][1]), (280, [0.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("v", F.lit(1)).withColumn("b", F.lit(2))
    vectors = topk.integer_vectors(df)
    queries = vectors.filter("vec_id % 20 = 0")
    for sizes in ((8192, 512), (17, 3)):
        got = topk.top_k(vectors, queries, 20, *sizes)
        assert parity(got, ORACLES["op4_topk"], embeddings=df.select("vec_id", "embedding")) == 20 * queries.count()
    few = topk.top_k(vectors.filter("vec_id < 5"), queries.filter("vec_id = 0"), 20).collect()
    assert sorted((r["rank"]) for r in few) == [1, 2, 3, 4]
    assert topk.top_k(vectors.limit(0), queries).count() == 0
    assert topk.top_k(vectors, queries.limit(0)).count() == 0


def test_topk_refuses_inexact_scores(spark):
    big = spark.createDataFrame([(0, [1 << 40, 1]), (1, [1 << 40, 2])], "vec_id bigint, v array<bigint>")
    with pytest.raises(ValueError):
        topk.top_k(big, big)


# sharding in pairs


def test_admitted_moves_keep_room():
    rng = random.Random(5)
    for _ in range(200):
        k = rng.randint(2, 7)
        asks = {(i, j): rng.randint(0, 9) for i in range(k) for j in range(k) if i != j}
        room = [rng.choice([0, 0, 3]) for _ in range(k)]
        got = sharding.admitted(asks, room)
        gain = [sum(n for (_, b), n in got.items() if b == s) - sum(n for (a, _), n in got.items() if a == s) for s in range(k)]
        assert all(g <= r for g, r in zip(gain, room)) and all(0 < n <= asks[p] for p, n in got.items())
        left = {p: n - got.get(p, 0) for p, n in asks.items()}
        free = [r - g for g, r in zip(gain, room)]
        # Nothing more can move: no shard that is asked for has room, and those asking form no cycle.
        assert not any(n and free[j] for (_, j), n in left.items())
        onward = {i: {j for (a, j), n in left.items() if a == i and n} for i in range(k)}
        while ends := [i for i, js in onward.items() if not js]:
            for e in ends:
                del onward[e]
                for js in onward.values():
                    js.discard(e)
        assert not onward


@pytest.mark.parametrize("alone", [0, 5])
def test_sharding_of_pairs_settles(spark, alone):
    """All rows in pairs, or 5 % of them unlinked: hardly any pair stays cut, and counts are even."""

    n = 4000
    rows = [(i, f"alone {i}" if i % 100 < alone else f"pair {i // 100} {(i % 100 - alone) // 2}") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    texts = dict(rows)
    placed = {r["doc_id"]: r["shard"] for r in sharding.assign(docs).collect()}
    sizes, by = Counter(placed.values()), defaultdict(list)
    for i, s in placed.items():
        by[texts[i]].append(s)
    assert set(sizes.values()) == {n // 40}
    pairs = [v for v in by.values() if len(v) > 1]
    assert len(pairs) > n * 0.45 and sum(len(set(v)) > 1 for v in pairs) < 0.02 * len(pairs)


# mixing


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        share = {s: w[s] * left / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= most * sizes[s]]
        if not over:
            return {**share, **{s: float(most * sizes[s]) for s in capped}}
        capped |= set(over)


def test_mixing_equals_sql(spark, parity):
    assert parity(QUERIES["op5_mixing"](spark, SF), ORACLES["op5_mixing"], documents=f"{SF}/documents.parquet") == 200


def test_mixing_against_plain_targets(spark, edge_docs, no_docs):
    docs = edge_docs.unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("*", *[F.lit("x").alias(c) for c in edge_docs.columns[5:]]))
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * len(r["shards"])
        assert len(r["shards"]) <= 3
    want = plain_targets(sizes)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for s, t in want.items():
        assert t - max(r["size"] for r in got if r["source"] == s) < taken[s] <= t + 1e-6
    again = {(r["doc_id"], r["text_hash"], tuple(r["shards"]), tuple(r["places"])) for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {(r["doc_id"], r["text_hash"], tuple(r["shards"]), tuple(r["places"])) for r in got}
    assert mixing.mix(no_docs).count() == 0
    kept = mixing.mixed_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(len(r["shards"]) for r in got)
    assert mixing.mixed_documents(no_docs).count() == 0


def permuted(doc_id, text):
    """The place of a document in its source's permutation, from 0 to 1."""

    digest = hashlib.md5(text.encode()).hexdigest()
    return int(hashlib.md5(f"{doc_id}:17:{digest}".encode()).hexdigest()[:8], 16) / 2**32


@pytest.mark.parametrize("share", [0.02, 0.3, 0.8])
def test_mixing_fills_up_around_a_giant_document(spark, share):
    """Wherever a giant stands in the permutation, its source misses the target by less than any unused document."""

    giant = min(range(1000, 1200), key=lambda i: abs(permuted(i, "w " * 500) - share))
    rows = [*[(i, "w " * (1 + i % 3), "a") for i in range(300)], (giant, "w " * 500, "a"), *[(2000 + i, "w " * 10, "b") for i in range(10)]]
    got = [r for r in mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), weights=(1, 1)).collect() if r["source"] == "a"]
    assert {r["target"] for r in got} == {900}
    unused = [r["size"] for r in got if not r["shards"]]
    assert 0 <= 900 - sum(r["size"] * len(r["shards"]) for r in got) < min(unused)


def plain_mix(sizes, rest):
    """The documents (sizes in permuted order) that repeated prefixes take for ``rest`` words."""

    taken = set()
    while fit := [i for i, z in enumerate(sizes) if i not in taken and 0 < z <= rest]:
        for i in fit:
            if sizes[i] > rest:
                break
            taken.add(i)
            rest -= sizes[i]
    return taken


def test_mixing_of_a_hot_id_equals_a_plain_mixer(spark):
    """A third of all rows share one id, another third have none."""

    rows = [(i if i % 3 == 0 else 7 if i % 3 == 1 else None, f"t{i} " + "w " * (i * i % 97), "a" if i % 4 else "b") for i in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), weights=(1, 1)).collect()
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "ab"}
    want = plain_targets(sizes, (1, 1))
    expected = Counter()
    for s in "ab":
        own = sorted((r for r in rows if r[2] == s), key=lambda r: permuted("" if r[0] is None else r[0], r[1]))
        passes, rest = divmod(int(want[s]), sizes[s])
        taken = plain_mix([len(t.split()) for _, t, _ in own], rest)
        expected.update((i, len(t.split()), passes + (k in taken)) for k, (i, t, _) in enumerate(own))
    assert Counter((r["doc_id"], r["size"], len(r["shards"])) for r in got) == expected


def test_many_sources_are_split_in_groups(spark):
    """Groups of sources, two levels deep, keep quotas and shard sizes as a flat draw does."""

    quota = {f"0s{i:04d}": 1 + i % 5 for i in range(700)} | {"0hot": 900}
    leaves = mixing.split_quotas(spark.createDataFrame(list(quota.items()), "skey string, blocks bigint"), 2, group=2).collect()
    per_shard, by = Counter(), Counter()
    for r in leaves:
        per_shard[r["shard"]] += r["to_block"] - r["from_block"]
        by[r["skey"]] += r["to_block"] - r["from_block"]
    assert by == Counter(quota) and max(per_shard.values()) - min(per_shard.values()) <= 1
    assert all(180 < r["to_block"] - r["from_block"] < 270 for r in leaves if r["skey"] == "0hot")


def test_splitting_tree_keeps_quotas(spark):
    quota = {"0a": 1000, "0b": 1, "0c": 333, "0d": 50, "1": 7}
    leaves = mixing.split_quotas(spark.createDataFrame(list(quota.items()), "skey string, blocks bigint"), 4).collect()
    per_shard, by = Counter(), defaultdict(list)
    for r in leaves:
        per_shard[r["shard"]] += r["to_block"] - r["from_block"]
        by[r["skey"]].append((r["shard"], r["from_block"], r["to_block"]))
    assert max(per_shard.values()) - min(per_shard[s] for s in range(16)) <= 1
    for s, n in quota.items():
        cuts = sorted(by[s])
        assert cuts[0][1] == 0 and cuts[-1][2] == n and all(a[2] == b[1] for a, b in zip(cuts, cuts[1:]))
    # a large source is spread about evenly: 1000 of 1391 blocks, 16 shards
    assert all(45 <= z - a <= 80 for _, a, z in by["0a"])


# fingerprints


def test_fingerprints_equal_sql(spark, edge_docs, no_docs, parity):
    assert parity(QUERIES["op7_fingerprints"](spark, SF), ORACLES["op7_fingerprints"], documents=f"{SF}/documents.parquet") == 200
    for bits in (10, 1):
        assert parity(merkle.fingerprints(edge_docs, bits), ORACLES["op7_fingerprints"], documents=edge_docs.select("doc_id", "text")) == edge_docs.count()
    assert merkle.fingerprints(no_docs).count() == 0
    one = merkle.fingerprints(edge_docs.filter("doc_id = 8")).collect()[0]
    assert one["near_next"] == 1.0


def test_fingerprints_of_crowded_ids_equal_sql(spark, parity):
    """A third of the rows have no id, a third one id, with few and with many copies; the
    crowds stand first, in the middle, last, side by side and alone."""

    def texts(n, kinds, seed):
        return [f"Line {(i * seed) % kinds} of it. And more!\nThe end {(i * seed) % 5}" for i in range(n)]

    null, one = [(None, t) for t in texts(60, 45, 7)], [(7, t) for t in texts(60, 3, 11)]
    rest = [(i * 3, t) for i, t in enumerate(texts(60, 60, 1))]
    side, last = one + [(8, t) for t in texts(30, 30, 1)], rest + [(10**6, t) for t in texts(40, 40, 3)]
    for rows, bits in ((null + one + rest, 10), (null + one + rest, 1), (side, 10), (last, 1), (null[:9], 10)):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert parity(merkle.fingerprints(docs, bits, run=4), ORACLES["op7_fingerprints"], documents=docs) == len(rows)


def test_fingerprints_tell_equal_texts(edge_docs):
    rows = merkle.fingerprints(edge_docs).join(edge_docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")), "doc_id").collect()
    assert len({r["fingerprint"] for r in rows}) == len({r["t"] for r in rows}) == len({(r["fingerprint"], r["t"]) for r in rows})


def test_following_over_sparse_ids(spark):
    ids = sorted({int(x) for x in np.random.default_rng(0).integers(-(2**62), 2**62, 300)} | {0, 1, 2, 3, -(2**63), 2**63 - 1})
    got = {r["key"]: r["next"] for r in merkle.following(spark.createDataFrame([(i,) for i in ids], "key bigint")).collect()}
    assert got == dict(zip(ids, ids[1:] + ids[:1]))


# SimHash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, radius=2):
    """doc_id → smallest doc_id reachable, by comparing every pair."""

    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(prints):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return [least[find(i)] for i in range(len(prints))]


def test_simhash_query_against_all_pairs(spark):
    texts = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    prints = [(d, plain_fingerprint(t)) for d, t in texts]
    got = sorted(QUERIES["op10_simhash"](spark, SF).collect(), key=lambda r: r["doc_id"])
    assert [(r["doc_id"], r["fingerprint"]) for r in got] == [(d, f"{p:016x}") for d, p in prints]
    assert [r["component_id"] for r in got] == plain_components(prints)


def test_simhash_xxh64_is_sparks(spark):
    df = spark.createDataFrame([("a b c",), ("ä",)], "t string").select(F.lower(F.hex(F.xxhash64("t"))).alias("h"), "t")
    assert all(int(r["h"], 16) == xxhash.xxh64_intdigest(r["t"].encode(), 42) for r in df.collect())


def test_links_and_components_of_random_prints(spark):
    rng = np.random.default_rng(2)
    start = rng.integers(0, 2**63, 60, dtype=np.uint64)
    prints = set(start.tolist()) | {0, 2**64 - 1, 3, 2**64 - 8}
    for x in start[:25].tolist():  # chains of near prints, longer than one link
        for _ in range(rng.integers(1, 12)):
            x ^= (1 << int(rng.integers(64))) | (1 << int(rng.integers(64)))
            prints.add(x)
    prints = sorted(prints)
    nodes = spark.createDataFrame([(p - (1 << 64) if p >= 1 << 63 else p,) for p in prints], "fp bigint")
    for tile in (2048, 3):
        got = {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes, 2, tile)).collect()}
        label = [got.get(x, x) for x in (p - (1 << 64) if p >= 1 << 63 else p for p in prints)]
        want = plain_components(list(enumerate(prints)))
        assert len(set(zip(label, want))) == len(set(label)) == len(set(want))


def test_components_of_long_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7000, 7000)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, **{1000 + i: 1000 for i in range(1, 50)}}


def test_simhash_edge_cases(spark, edge_docs, no_docs):
    rows = simhash.with_components(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert {r["component_id"] for r in rows if r["doc_id"] in (3, 4, 6)} == {3}
    kept = simhash.one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns
    components = {r["component_id"] for r in rows}
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(components, key=str)
    assert simhash.with_components(no_docs).count() == 0 and simhash.one_of_each(no_docs).count() == 0


def test_simhash_keeps_a_row_of_each_group_under_null_and_repeated_ids(spark):
    words = [" ".join(f"{k}{i}" for i in range(40)) for k in ("red", "green", "blue", "grey", "pink")]
    # three unlike texts without an id; id 1 with two unlike texts; id 2 a copy of the second of these
    rows = [(None, words[0]), (None, words[1]), (None, words[2]), (1, words[3]), (1, words[4]), (2, words[4]), (None, words[0])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.one_of_each(docs).collect()), key=str)
    assert kept == sorted([(None, words[0]), (None, words[1]), (None, words[2]), (1, words[3]), (1, words[4])], key=str)


# shared helpers


def test_ranked_in_groups_and_join_skewed(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("w"), common.hash32(F.col("id")).alias("h"), "id")
    got = common.ranked_in_groups(df, ["g"], ["h", "id"], "w", rows=500, into=20).collect()
    for g in range(3):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: (r["h"], r["id"]))
        assert [r["rank"] for r in own] == list(range(len(own)))
        assert [r["before"] for r in own] == [sum(x["w"] or 0 for x in own[:i]) for i in range(len(own))]
    left = spark.createDataFrame([("hot",)] * 900 + [(f"k{i}",) for i in range(400)] + [(None,), ("alone",)], "k string")
    right = left.filter("k <> 'alone'").groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("k"))
    out = common.join_skewed(left, right, "k", "n")
    assert out.count() == 1300 and out.filter("k <> v").count() == 0
