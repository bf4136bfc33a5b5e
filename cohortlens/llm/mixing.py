"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source's share of all words follows its weight, but no target exceeds
``most`` times the source's own words; what a capped source leaves is reshared by
weight. A source gives whole documents: all of them for each full pass that fits
its target, then permuted prefixes: of the documents not yet taken that fit into
what is missing, as many as fit in permuted order, again and again until none does.
So a source misses its target by less than its smallest unused document with words.
These document copies, permuted and cut into blocks of equal count, are the source's
exact block quota. A binary tree over the output shards splits all quotas at once: at
every node the left half's blocks are a multivariate-hypergeometric draw, so shard
sizes stay equal and every source stays whole. A shard's blocks are the next ones of
each source's permutation (disjoint by construction) and are shuffled inside the shard.

All of it is DataFrame and SQL functions. Only (id, source, size, hash) rows are
moved; slices of a source are ranked apart, so a hot source fills no single task.
The tables of sources and of tree nodes have one row a source (and node); a draw over
many sources is split into draws over groups of sources first, so no row holds them all.

Defined cases: a null text has no words, a null source is a source (the last);
documents without words take 0 whatever their copies; with no words at all every
target is 0. Rows sharing an id are ranked as separate documents. An empty table
gives an empty mix. Draws hang on ids, texts and a seed alone, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import WORD_PATTERN, free_name, hash32, join_small, ranked_in_groups, save

WEIGHTS = (5, 2, 1)
SEED = 17


def order_hash(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """An even hash of id and text in [0, 2^32) that any SQL engine with MD5 can
    repeat; texts of one hot id spread."""

    digest = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}:"), digest)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, text hash, source and its key (never null, in code-point order, null last), size in words, hash."""

    words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    source = F.col("source").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
        F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source)).alias("skey"),
        words.alias("size"), order_hash(F.col("doc_id"), F.col("text").cast("string")).alias("h"),
    )


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """One row a source: its words, documents, target and whole-word quota."""

    big = "decimal(24,0)"
    own = rows.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    place = (F.row_number().over(Window.orderBy("skey")) - 1) % len(weights)
    own = own.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("long"))
    every = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "skey").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumns({
        "all_": F.sum("source_size").over(every), "w_": F.sum("weight").over(every),
        "c_": F.coalesce(F.sum(F.col("source_size") * most).over(by_ratio), F.lit(0)), "v_": F.coalesce(F.sum("weight").over(by_ratio), F.lit(0)),
    })
    # Sources in order of cap / weight: one is capped if the share left to it reaches its cap.
    left = (F.col("all_") - F.col("c_")).cast(big)
    capped = left * F.col("weight").cast("decimal(12,0)") >= (F.col("source_size") * most).cast(big) * (F.col("w_") - F.col("v_")).cast("decimal(12,0)")
    own = own.withColumn("capped", capped)
    cap = F.when(F.col("capped"), F.col("source_size") * most)
    own = own.withColumns({"c_": F.coalesce(F.sum(cap).over(every), F.lit(0)), "v_": F.coalesce(F.sum(F.when(F.col("capped"), F.col("weight"))).over(every), F.lit(0))})
    share = (F.col("weight") * (F.col("all_") - F.col("c_"))).cast("double") / (F.col("w_") - F.col("v_")).cast("double")
    own = own.withColumn("target", F.when(F.col("capped"), (F.col("source_size") * most).cast("double")).otherwise(share))
    own = own.withColumn("quota", F.floor("target").cast("long"))
    passes = F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(F.lit(0))
    own = own.withColumn("passes", passes.cast("long"))
    return own.select("skey", "source_size", "docs", "target", "passes", (F.col("quota") - F.col("passes") * F.col("source_size")).alias("rest"))


def chosen(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """Each document with its rank in its source's permutation and its ``copies`` in the mix."""

    rows = save(sized(docs), "mix-rows")
    sources = save(targets(rows, weights, most), "mix-sources")
    order = ["h", "id_", "size", "text_hash"]
    ranked = ranked_in_groups(rows.withColumn("id_", F.coalesce("doc_id", F.lit(-1))), ["skey"], order, None, rows=rows.count())
    ranked = ranked.select("doc_id", "text_hash", "skey", "size", "h", "rank")
    placed = save(join_small(ranked, sources, "skey").drop("docs"), "mix-placed")
    fitting = placed.filter((F.col("size") > 0) & (F.col("size") <= F.col("rest")))
    taken = prefixes(fitting.select("skey", F.col("rank").alias("doc"), "h", "size", F.col("rest").alias("missing")))
    if taken is None:
        more = placed.withColumn("late", F.lit(False))
    else:
        more = placed.join(taken.select("skey", F.col("doc").alias("rank"), F.lit(True).alias("late")), ["skey", "rank"], "left")
    out = more.withColumn("copies", (F.col("passes") + F.coalesce("late", F.lit(False)).cast("long")).cast("int"))
    return out.select("doc_id", "text_hash", "skey", "rank", "size", "source_size", "target", "copies")


def prefixes(fitting: DataFrame) -> DataFrame | None:
    """(skey, doc) of the documents taken by repeated permuted prefixes of ``fitting``
    (skey, doc, h, size, missing), until no unused document fits; null if none does
    at the start. Each pass takes a source's first fitting document at least, and
    the document that ends it is larger than what stays missing, so it drops out."""

    got = None
    fitting = save(fitting, "mix-fitting")
    while n := fitting.count():
        ranked = ranked_in_groups(fitting, ["skey"], ["h", "doc"], "size", rows=n).drop("rank")
        passed = save(ranked.withColumn("inside", F.col("before") + F.col("size") <= F.col("missing")), "mix-passed")
        taken = passed.filter("inside").select("skey", "doc")
        got = taken if got is None else got.unionByName(taken)
        left = passed.groupBy("skey").agg((F.first("missing") - F.coalesce(F.sum(F.when(F.col("inside"), F.col("size"))), F.lit(0))).alias("missing"))
        unused = passed.filter("NOT inside").select("skey", "doc", "h", "size")
        fitting = save(join_small(unused, save(left, "mix-left"), "skey").filter("size <= missing"), "mix-fitting")
    return got


#: A draw is over at most about GROUP sources or FAN groups of them.
GROUP, FAN = 128, 256


def _drawn(gathered: DataFrame, level: int, seed: int) -> DataFrame:
    """(node, q: skey and n, l: what the left half gets) of one draw of ``m`` blocks
    without replacement from ``q``, whose blocks are ``total``."""

    draw = f"""aggregate(q, named_struct('left', total, 'm', m, 'out', cast(array() as array<bigint>)), (s, x) -> aggregate(array(
            named_struct('mu', double(s.m) * x.n / greatest(s.left, 1),
                         'sd', sqrt(double(s.m) * x.n / greatest(s.left, 1) * (1 - double(x.n) / greatest(s.left, 1)) * (s.left - s.m) / greatest(s.left - 1, 1)),
                         'u', (pmod(xxhash64(x.skey, node, {level}, {seed}), 9007199254740992) + 0.5D) / 9007199254740992D)), s, (t, d) ->
            aggregate(array(greatest(0L, s.m - (s.left - x.n), bigint(floor(d.mu - 8 * d.sd - 2)))), t, (t1, lo) ->
            aggregate(array(greatest(lo, least(x.n, s.m, bigint(ceil(d.mu + 8 * d.sd + 2))))), t1, (t2, hi) ->
            aggregate(array(d.u * aggregate(sequence(lo, hi), named_struct('w', 1.0D, 'sum', 0.0D), (a, k) -> named_struct(
                'w', a.w * (x.n - k) * (s.m - k) / ((k + 1.0D) * greatest(s.left - x.n - s.m + k + 1, 1)), 'sum', a.sum + a.w), a -> a.sum)), t2, (t3, bar) ->
            aggregate(array(aggregate(sequence(lo, hi), named_struct('w', 1.0D, 'sum', 0.0D, 'got', lo), (a, k) -> named_struct(
                'w', a.w * (x.n - k) * (s.m - k) / ((k + 1.0D) * greatest(s.left - x.n - s.m + k + 1, 1)), 'sum', a.sum + a.w,
                'got', if(a.sum < bar, k, a.got)), a -> a.got)), t3, (t4, got) ->
            named_struct('left', s.left - x.n, 'm', s.m - got, 'out', concat(s.out, array(got)))))))), s -> s.out)"""
    return gathered.select("node", F.explode(F.arrays_zip(F.col("q").alias("q"), F.expr(draw).alias("l"))).alias("e")).select("node", "e.q", "e.l")


def split_quotas(quotas: DataFrame, levels: int, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """(skey, shard, from_block, to_block): the tree's leaves, each with the next
    blocks of every source's permutation. ``quotas`` has (skey, blocks)."""

    sources, depth = quotas.count(), 0
    while sources > group * FAN**depth:
        depth += 1

    def prefix(i: int) -> Column:
        """The group of a source i levels down: the first bytes of its hash."""

        return F.shiftright(hash32(F.col("skey"), F.lit(seed + 2)), 32 - 8 * i) if i else F.lit(0).cast("long")

    def gathered(parts: DataFrame, *keys: str) -> DataFrame:
        return parts.groupBy("node", *keys).agg(F.sort_array(F.collect_list(F.struct("skey", "n"))).alias("q"), F.sum("n").alias("total"))

    node = quotas.select(F.lit(0).alias("node"), "skey", F.col("blocks").cast("long").alias("n"))
    for level in range(levels):
        if not depth:
            drawn = _drawn(gathered(node).withColumn("m", F.expr("total div 2")), level, seed)
        else:
            node = save(node, "mix-nodes")
            half = node.groupBy("node").agg(F.sum("n").alias("t")).select("node", F.lit(0).cast("long").alias("g"), F.expr("t div 2").alias("m"))
            for i in range(1, depth + 1):
                inner = node.groupBy("node", prefix(i - 1).alias("g"), prefix(i).cast("string").alias("skey")).agg(F.sum("n").alias("n"))
                found = _drawn(gathered(inner, "g").join(half, ["node", "g"]), level, seed)
                half = save(found.select("node", F.col("q.skey").cast("long").alias("g"), F.col("l").alias("m")), "mix-halves")
            drawn = _drawn(gathered(node.withColumn("g", prefix(depth)), "g").join(half, ["node", "g"]), level, seed)
        n, left = F.col("q.n"), F.col("l")
        node = drawn.select(F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), F.col("q.skey").alias("skey"), left.alias("n")), F.struct((F.col("node") * 2 + 1).alias("node"), F.col("q.skey").alias("skey"), (n - left).alias("n")))).alias("c")).select("c.*")
    past = Window.partitionBy("skey").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(past), F.lit(0))
    return node.select("skey", F.col("node").alias("shard"), start.alias("from_block"), (start + F.col("n")).alias("to_block"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, levels: int = 5, blocks: int = 1 << 14) -> DataFrame:
    """Each document once, with ``shards``: the output shard of each of its copies
    (2^levels shards; empty for a document left out), and ``places``: the copy's
    sort key inside its shard. About ``blocks`` blocks in all are dealt."""

    plan = save(chosen(docs, weights, most), "mix-plan")
    copies = plan.agg(F.sum("copies")).first()[0] or 0
    each = max(1, copies // blocks)
    units = plan.filter("copies > 0").select("skey", F.col("rank").alias("doc"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    units = units.withColumn("g", hash32(F.col("skey"), F.col("doc"), F.col("copy"), F.lit(SEED)))
    dealt = ranked_in_groups(units, ["skey"], ["g", "doc", "copy"], None, rows=copies).withColumn("block", F.floor(F.col("rank") / F.lit(each)))
    quotas = plan.groupBy("skey").agg(F.sum("copies").alias("n")).filter("n > 0").select("skey", F.ceil(F.col("n") / F.lit(each)).alias("blocks"))
    leaves = save(split_quotas(quotas, levels), "mix-leaves")
    # One row a source: the first block of each shard, for a search instead of a range join.
    starts = save(leaves.groupBy("skey").agg(F.sort_array(F.collect_list(F.struct("to_block", "shard"))).alias("ends")), "mix-starts")
    shard = F.filter("ends", lambda e: e["to_block"] > F.col("block"))[0]["shard"]
    found = join_small(dealt, starts, "skey").select("skey", "doc", shard.alias("shard"), F.xxhash64("skey", "doc", "copy", F.lit(SEED + 1)).alias("place"))
    per_doc = found.groupBy("skey", "doc").agg(F.sort_array(F.collect_list(F.struct("shard", "place"))).alias("p"))
    per_doc = per_doc.withColumnRenamed("doc", "rank")
    out = plan.join(per_doc, ["skey", "rank"], "left")
    none = F.array()
    return out.select(
        "doc_id", "text_hash", F.when(F.col("skey") != "1", F.substring("skey", 2, 1 << 30)).alias("source"), "size", "source_size", "target",
        F.coalesce(F.col("p.shard"), none.cast("array<int>")).alias("shards"), F.coalesce(F.col("p.place"), none.cast("array<bigint>")).alias("places"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, a row for each copy. Rows with the
    same id, source and text stand for one another."""

    keys = ["doc_id", "source", "text_hash"]
    taken = save(mix(docs, **options).filter("size(shards) > 0").groupBy(*keys).agg(F.sum(F.size("shards")).alias("copies_"), F.count(F.lit(1)).alias("rows_")), "mix-taken")
    digest, copies = free_name(docs, "hash_"), free_name(docs, "copy_")
    whole = docs.withColumn(digest, F.xxhash64(F.col("text").cast("string")))
    doubled = taken.filter("rows_ > 1").head(1) or docs.groupBy("doc_id").count().filter("count > 1").head(1)
    if doubled:
        whole = whole.dropDuplicates(["doc_id", "source", digest])
    same = whole["doc_id"].cast("long").eqNullSafe(taken["doc_id"]) & whole["source"].cast("string").eqNullSafe(taken["source"]) & (whole[digest] == taken["text_hash"])
    some = taken.select(*keys, "copies_")
    out = whole.join(some, same, "inner").select(*[whole[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), some["copies_"].cast("int"))).alias(copies))
    return out.drop(copies)


#: The words taken, in SQL (the draw of shards does not change the words). ``p`` repeats the prefix passes.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':17:' || md5(coalesce(text, ''))), 1, 8))::BIGINT AS h FROM documents),
s0 AS (SELECT source, sum(size)::HUGEINT AS z, ([5, 2, 1])[1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT]::HUGEINT AS w FROM d GROUP BY source),
s1 AS (SELECT *, sum(z) OVER () AS t, sum(w) OVER () AS ws,
    coalesce(sum(3 * z) OVER r, 0) AS c, coalesce(sum(w) OVER r, 0) AS v FROM s0
    WINDOW r AS (ORDER BY z::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s2 AS (SELECT source, z, w, t, ws, (t - c) * w >= 3 * z * (ws - v) AS capped FROM s1),
s3 AS (SELECT *, coalesce(sum(CASE WHEN capped THEN 3 * z END) OVER (), 0) AS c, coalesce(sum(CASE WHEN capped THEN w END) OVER (), 0) AS v FROM s2),
s4 AS (SELECT source, z::BIGINT AS source_size, CASE WHEN capped THEN (3 * z)::DOUBLE ELSE (w * (t - c))::DOUBLE / (ws - v)::DOUBLE END AS target FROM s3),
s AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS passes, floor(target)::BIGINT - CASE WHEN source_size > 0 THEN (floor(target)::BIGINT // source_size) * source_size ELSE 0 END AS rest FROM s4),
r AS (SELECT d.*, s.source_size, s.target, s.passes, s.rest, row_number() OVER (PARTITION BY d.source ORDER BY h, coalesce(doc_id, -1), d.size) AS rank
    FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
p AS (SELECT source, rank, size, rest AS missing, FALSE AS taken FROM r WHERE size > 0
  UNION ALL
  SELECT source, rank, size, (missing - coalesce(sum(CASE WHEN upto <= missing THEN size END) OVER (PARTITION BY source), 0))::BIGINT, upto <= missing
  FROM (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank ROWS UNBOUNDED PRECEDING) AS upto FROM p WHERE NOT taken AND size <= missing)),
f AS (SELECT source, rank FROM p WHERE taken)
SELECT doc_id, size, source_size, target, (size * (passes + CASE WHEN f.rank IS NOT NULL THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r LEFT JOIN f ON r.source IS NOT DISTINCT FROM f.source AND r.rank = f.rank
"""
