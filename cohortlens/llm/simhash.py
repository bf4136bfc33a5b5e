"""SimHash near-duplicates by tiled exact comparison.

Each whole text gets a 64-bit fingerprint: the majority bits of its word
shingles' XXH64. Distinct fingerprints go into cells by the population counts of
their four 16-bit quarters. Two fingerprints within ``radius`` bits have counts
that differ by at most ``radius`` in all, so only tiles (bounded blocks) of such
cells meet; all other tile pairs are skipped with proof. Numpy compares a tile
pair by exclusive-or and bit counts. Links within a pair of tiles shrink to a
spanning forest at once, so no group emits all its pairs; components then come
from alternating star contractions, each written to the shared folder.

Defined cases: a null or empty text has no shingle and fingerprint 0, which links
like any other; a text with fewer words than a shingle counts as one shingle;
equal texts, and repeated rows, share a fingerprint and so a component; a null
doc_id never names a component unless all ids in it are null. Only ids and
texts are read, so other columns may have any name.
"""

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import free_name, join_skewed, save

SEED = 42
TILE = 2048
QUARTERS = 4


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of a whole text (0 without words)."""

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(line, SEED)], dtype=np.uint64)
    else:
        stops = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
        starts = [0, *(s + 1 for s in stops[:-1])]
        one = xxhash.xxh64_intdigest
        hashes = np.array([one(line[i:j], SEED) for i, j in zip(starts, stops[shingle - 1 :])], dtype=np.uint64)
    set_bits = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        some = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(set_bits * 2 > len(hashes)).astype(np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", into: str = "fp") -> DataFrame:
    """Add ``into``: the fingerprint as a signed long."""

    @F.pandas_udf("bigint")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).astype(np.int64))

    return docs.withColumn(into, run(F.col(text).cast("string")))


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node linked to each of ``n`` nodes by the edges (a, b)."""

    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def tile_links(own: np.ndarray, other: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles (or inside one)."""

    n = len(own)
    both = own if same else np.concatenate([own, other])
    label = np.arange(len(both))
    rows = max(1, 4_000_000 // max(1, len(other)))
    for i in range(0, n, rows):
        hit = np.bitwise_count(own[i : i + rows, None] ^ other[None, :]) <= radius
        a, b = np.nonzero(hit)
        a, b = a + i, b if same else b + n
        if same:
            a, b = a[a < b], b[a < b]
        if len(a):
            at = np.flatnonzero(label != np.arange(len(both)))
            label = spanning(np.append(a, at), np.append(b, label[at]), len(both))
    at = np.flatnonzero(label != np.arange(len(both)))
    return both[at], both[label[at]]


def links(nodes: DataFrame, radius: int = 2, tile: int = TILE) -> DataFrame:
    """(a, b): links that join all fingerprints (column ``fp``, distinct) whose
    chains of at most ``radius`` differing bits connect them."""

    base = 64 // QUARTERS + 1
    count = [F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))).cast("int") for i in range(QUARTERS)]
    placed = nodes.select("fp", sum((c * F.lit(base**i) for i, c in enumerate(count[1:], 1)), count[0]).cast("int").alias("cell"))
    # At most base^QUARTERS cells (83,521), whatever the input.
    cells = save(placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("tiles")), "simhash-cells")
    dealt = placed.join(F.broadcast(cells), "cell").withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    tiles = save(dealt.groupBy("cell", "tile").agg(F.collect_list("fp").alias("fps")), "simhash-tiles")
    steps = [s for s in product(range(-radius, radius + 1), repeat=QUARTERS) if sum(map(abs, s)) <= radius]
    digit = [F.floor(F.col("cell") / F.lit(base**i)).cast("int") % base for i in range(QUARTERS)]
    # A step counts where each quarter's count stays within 0 .. 16; of both directions only the rising one is taken.
    targets = F.array(*[
        F.when(
            F.lit(sum(d * base**i for i, d in enumerate(s)) >= 0)
            & F.expr(" AND ".join(f"(floor(cell / {base**i}) % {base}) + ({d}) BETWEEN 0 AND {base - 1}" for i, d in enumerate(s))),
            F.col("cell") + F.lit(sum(d * base**i for i, d in enumerate(s))),
        )
        for s in steps
        if sum(d * base**i for i, d in enumerate(s)) >= 0
    ])
    near = tiles.withColumn("to_cell", F.explode(F.array_compact(targets)))
    near = near.join(F.broadcast(cells.withColumnRenamed("cell", "to_cell")), "to_cell")
    near = near.withColumn("to_tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    near = near.filter((F.col("to_cell") != F.col("cell")) | (F.col("to_tile") >= F.col("tile")))
    near = near.withColumn("same", (F.col("to_cell") == F.col("cell")) & (F.col("to_tile") == F.col("tile")))
    far = tiles.select(F.col("cell").alias("to_cell"), F.col("tile").alias("to_tile"), F.col("fps").alias("others"))
    pairs = near.select("to_cell", "to_tile", "same", "fps").join(far.hint("shuffle_merge"), ["to_cell", "to_tile"])
    pairs = pairs.filter("NOT same OR size(fps) > 1").select("same", "fps", "others")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [tile_links(np.asarray(x, dtype=np.int64).view(np.uint64), np.asarray(y, dtype=np.int64).view(np.uint64), bool(s), radius) for s, x, y in zip(batch["same"], batch["fps"], batch["others"])]
            yield pd.DataFrame({k: np.concatenate([f[i] for f in found] or [np.zeros(0, np.uint64)]).view(np.int64) for i, k in enumerate("ab")})

    return pairs.mapInPandas(compare, "a bigint, b bigint")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the smallest node of each linked node's component, by
    alternating large-star and small-star steps until nothing changes."""

    high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = save(edges.filter("a <> b").select(high, low).distinct(), name)
    state = None
    while True:
        told = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(told) == state or told[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = tuple(told)
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        root = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = ways.filter("b > a").join(root, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        # Smaller neighbours already are roots of a star here: link them, and the node, to the smallest.
        large = large.unionByName(ways.groupBy("a").agg(F.min("b").alias("b")).filter("b < a")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        edges = save(small.distinct(), name)


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): rows has each document's doc_id, ``text_hash`` and fingerprint
    ``fp``; groups has for each distinct ``fp`` the ``root`` of its component, the
    doc_id (``component_id``) and ``text_hash`` of that component's least row (null
    ids last), and the number ``n`` of the rows of ``fp``. Both are saved tables."""

    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), text_hash(F.col("text")).alias("text_hash"))
    rows = save(fingerprints(told, shingle).select("doc_id", "text_hash", "fp"), "simhash-rows")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    nodes = save(rows.groupBy("fp").agg(F.min(row).alias("first"), F.count(F.lit(1)).alias("n")), "simhash-nodes")
    root = components(links(nodes, radius), "simhash-links")
    # Only linked fingerprints are in ``root``; the others stand alone.
    rooted = nodes.join(root, F.col("fp") == F.col("node"), "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    groups = rooted.join(least, "root").select("fp", "root", F.col("least.doc_id").alias("component_id"), F.col("least.text_hash").alias("text_hash"), "n")
    return rows, save(groups, "simhash-groups")


def text_hash(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def with_components(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``."""

    rows, groups = near_duplicates(docs, shingle, radius)
    return join_skewed(rows.select("doc_id", "fp"), groups.select("fp", "component_id", "n"), "fp", "n").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row of ``docs`` for each component: the least by doc_id (null ids last)
    and text hash; of rows that repeat both a single one stays."""

    rows, groups = near_duplicates(docs, shingle, radius)
    kept = groups.filter("fp = root").select(F.col("component_id").alias("keep_"), F.col("text_hash").alias("keep_hash_"))
    digest = free_name(docs, "hash_")
    whole = docs.withColumn(digest, text_hash(F.col("text")))
    out = whole.join(kept, whole["doc_id"].cast("long").eqNullSafe(kept["keep_"]) & (whole[digest] == kept["keep_hash_"]), "left_semi")
    # ids are unique in a corpus; only where they are not must rows meet again
    if rows.groupBy("doc_id", "text_hash").count().filter("count > 1").head(1):
        out = out.dropDuplicates(["doc_id", digest])
    return out.drop(digest)
