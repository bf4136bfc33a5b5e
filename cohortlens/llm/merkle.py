"""Document fingerprints: a Merkle tree over sections, paragraphs and passages.

A text's lines are its paragraphs; a paragraph is cut into passages that end with a
sentence mark or after 48 code points, so an edit disturbs the passages up to the
next mark or line only. Passages are the hashed leaves; a paragraph hashes its
leaves, a section hashes eight paragraphs, the root hashes the sections. The root
is the fingerprint: equal roots mean equal texts. Where roots differ, differing
paragraphs locate the edit and the share of common leaves tells how much is alike.

Finding the next document by ascending id needs no global order: ids are cut into
ranges of ``WIDTH`` consecutive numbers, which bounds the distinct ids of a range;
a window works inside a range, and a copy of each range's first document goes to
the range before it. Ranges themselves are followed up the same way, level by
level, until a level spans few numbers. Texts are shuffled once, and a document
takes the tree of its next one from that row instead of hashing it again.

An id that very many rows share (or that is null in them) would make its range hot.
In its range only its first text stands for it; its equal rows are counted, and its
different texts are cut into slices of about ``RUN`` by their hash, each with a copy
of the next slice's first text. Only the slices' numbers of an id (one for about
``RUN`` texts) meet in one window.

Only DataFrame functions are used. Defined cases: a null text is the empty text;
a null id sorts before all others; rows with the same id follow one another by the
MD5 of their texts; a single row is its own next; an empty table gives no rows; a very
long text has more leaves, never fewer. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import save

LEAF = r"[^.!?]{1,48}[.!?]{0,8}|[.!?]{1,8}"
SECTION = 8
BITS = 10  # a range holds 2^BITS consecutive ids
LEAST_ID = -(2**63)
RUN = 1024  # rows of one id that stay in their range's window
MOST_RUNS = 65_536  # ids with more rows than RUN and than one in MOST_RUNS of all: at most so many
NEXT = {"next_text": "text", "after_leaves": "own_leaves", "after_root": "own_root"}


def tree(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add ``{name}_leaves``, ``{name}_paragraphs`` and ``{name}_root`` of a text column."""

    def short(c: Column) -> Column:
        return F.substring(F.md5(c.cast("binary")), 1, 16)

    def joined(c: Column) -> Column:
        return F.md5(F.array_join(c, "").cast("binary"))

    nested, paragraphs, sections = f"{name}_nested", f"{name}_paragraphs", f"{name}_sections"
    df = df.withColumn(nested, F.transform(F.split(F.col(text), "\n", -1), lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), short)))
    df = df.withColumn(paragraphs, F.transform(nested, joined))
    starts = F.sequence(F.lit(0), F.expr(f"int((size({paragraphs}) - 1) div {SECTION})"))
    df = df.withColumn(sections, F.transform(starts, lambda i: joined(F.slice(paragraphs, i * SECTION + 1, F.lit(SECTION)))))
    return df.withColumns({f"{name}_root": joined(F.col(sections)), f"{name}_leaves": F.array_distinct(F.flatten(nested))}).drop(nested, sections)


def likeness(a: str, b: str) -> Column:
    """1 for equal roots, else the share of leaves that two trees have in common."""

    x, y = F.col(f"{a}_leaves"), F.col(f"{b}_leaves")
    common = F.size(F.array_intersect(x, y)) * 2.0 / F.greatest(F.size(x) + F.size(y), F.lit(1))
    return F.when(F.col(f"{a}_root") == F.col(f"{b}_root"), F.lit(1.0)).otherwise(common)


def following(keys: DataFrame, bits: int = BITS) -> DataFrame:
    """(key, next): the next larger of distinct long keys, and the least key after
    the greatest. No task sorts more than 2^16 keys or one range of 2^bits."""

    least, most = keys.agg(F.min("key"), F.max("key")).first()
    if least is None or most - least < 1 << 16:
        whole = Window.orderBy("key")
        return keys.select("key", F.coalesce(F.lead("key").over(whole), F.lit(least).cast("long")).alias("next"))
    inside = Window.partitionBy("range").orderBy("key")
    cut = keys.withColumn("range", F.shiftright("key", bits)).withColumn("next", F.lead("key").over(inside))
    firsts = save(cut.groupBy("range").agg(F.min("key").alias("first")), "merkle-firsts")
    after = following(firsts.select(F.col("range").alias("key")), bits).withColumnRenamed("next", "next_range")
    onward = after.join(firsts.select(F.col("range").alias("next_range"), "first"), "next_range").select(F.col("key").alias("range"), "first")
    return cut.join(onward, "range").select("key", F.coalesce("next", "first").alias("next"))


def followed(rows: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """Add each row's own tree, and the text, leaves and root of the row after it in its
    group (null after the last). Trees are made once the rows are together."""

    rows = tree(rows.repartition(*groups), "text", "own")
    inside = Window.partitionBy(*groups).orderBy(*order)
    return rows.withColumns({name: F.lead(of).over(inside) for name, of in NEXT.items()})


def in_ranges(rows: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """The rows (id_, h, text and others) with their ``range``, and for each range a copy
    of the first rows of the one after it, which sort behind (``guest`` 1)."""

    own = rows.withColumns({"range": F.shiftright("id_", bits), "guest": F.lit(0)})
    firsts = save(own.groupBy("range").agg(F.min("id_").alias("first")), "merkle-ranges")
    after = following(firsts.select(F.col("range").alias("key")), bits)
    guests = save(after.join(firsts, F.col("next") == F.col("range")).select(F.col("first").alias("id_"), F.col("key").alias("range")), "merkle-guests")
    return own, rows.join(guests, "id_").withColumn("guest", F.lit(1)).select(*own.columns)


def in_slices(crowd: DataFrame, onward: DataFrame) -> DataFrame:
    """The different texts of crowded ids, followed: ``crowd`` has id_, h, text, copies and
    slice, ``onward`` the text that comes after each id's last."""

    heads = crowd.groupBy("id_", "slice").agg(F.min(F.struct("h", "text")).alias("head"))
    heads = save(heads.select("id_", "slice", "head.*"), "merkle-heads")
    steps = heads.select("id_", "slice").withColumn("to", F.lead("slice").over(Window.partitionBy("id_").orderBy("slice")))
    following_heads = heads.select("id_", F.col("slice").alias("to"), "h", "text")
    inner = steps.filter("to IS NOT NULL").join(following_heads, ["id_", "to"]).select("id_", "slice", "h", "text")
    last = steps.filter("to IS NULL").join(onward, "id_").select("id_", "slice", F.lit(0).cast("long").alias("h"), "text")
    visitors = inner.unionByName(last).withColumns({"guest": F.lit(1), "copies": F.lit(0).cast("long"), "doc_id": F.lit(None).cast("long")})
    both = crowd.withColumn("guest", F.lit(0)).unionByName(visitors)
    return followed(both, ["id_", "slice"], ["guest", "h", "text"]).filter("guest = 0")


def compared(rows: DataFrame, *others: str) -> DataFrame:
    """The result columns from a text, its own tree and its next text and tree."""

    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring(F.col("next_text"), F.lit(1), quarter)))
    rows = tree(rows, "edited", "edit")
    differs = F.array_position(F.zip_with("own_paragraphs", "edit_paragraphs", lambda x, y: x.eqNullSafe(y)), False)
    return rows.select(
        "doc_id", *others, "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.col("own_root").alias("fingerprint"), F.col("edit_root").alias("edited_fingerprint"),
        likeness("own", "edit").alias("near_edited"), likeness("own", "after").alias("near_next"),
        F.when(differs > 0, differs - 1).alias("edited_paragraph"),
    )


def repeated(rows: DataFrame, run: int) -> DataFrame:
    """Each row ``copies`` times, dealt out in parts of at most ``run``."""

    parts = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / run))))
    size = F.least(F.lit(run).cast("long"), F.col("copies") - F.col("part") * run)
    dealt = parts.withColumn("copies", size).repartition("id_", "h", "part")
    return dealt.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("id_", "h", "part", "copies", "copy")


def fingerprints(docs: DataFrame, bits: int = BITS, run: int = RUN) -> DataFrame:
    """Fingerprints of each text and of its edited text, and what they have in common."""

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = rows.select(F.coalesce("doc_id", F.lit(LEAST_ID)).alias("id_"))
    least = max(run, ids.count() // MOST_RUNS)
    runs = save(ids.groupBy("id_").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least), "merkle-runs")
    h = F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 8), 16, 10).cast("long")
    rows = rows.withColumns({"id_": F.coalesce("doc_id", F.lit(LEAST_ID)), "h": h})
    order = ["guest", "id_", "h", "text"]
    if not runs.head(1):
        own, guests = in_ranges(rows, bits)
        return compared(followed(own.unionByName(guests), ["range"], order).filter("guest = 0"))

    crowd = rows.join(F.broadcast(runs.select("id_")), "id_").groupBy("doc_id", "id_", "h", "text").agg(F.count(F.lit(1)).alias("copies"))
    crowd = save(crowd, "merkle-crowd")
    slices = crowd.groupBy("id_").agg(F.ceil(F.count(F.lit(1)) / run).alias("slices"), F.min(F.struct("h", "text")).alias("first"))
    slices = save(slices, "merkle-slices")
    cut = F.floor(F.col("h") * F.col("slices") / F.lit(2**32)).cast("long")
    crowd = crowd.join(F.broadcast(slices.select("id_", "slices")), "id_").withColumn("slice", cut).drop("slices")
    # The first text of a crowded id stands for it in its range.
    plain = rows.join(F.broadcast(runs.select("id_")), "id_", "left_anti").withColumn("stands", F.lit(False))
    stand = slices.select(F.lit(None).cast("long").alias("doc_id"), "first.text", "id_", "first.h").withColumn("stands", F.lit(True))
    own, guests = in_ranges(plain.unionByName(stand.select(*plain.columns)), bits)
    both = own.unionByName(guests)
    here = slices.select(F.shiftright("id_", bits).alias("range")).distinct()
    inside = Window.partitionBy("range").orderBy(*order)
    onward = both.join(F.broadcast(here), "range", "left_semi").withColumn("onward", F.lead("text").over(inside))
    onward = save(onward.filter("guest = 0 AND stands").select("id_", F.col("onward").alias("text")), "merkle-onward")
    done = compared(followed(both, ["range"], order).filter("guest = 0 AND NOT stands"))
    crowded = in_slices(crowd, onward)
    own_next = crowded.filter("copies > 1").withColumns({"copies": F.col("copies") - 1, **{name: F.col(of) for name, of in NEXT.items()}})
    many = compared(crowded.withColumn("copies", F.lit(1).cast("long")).unionByName(own_next), "id_", "h", "copies")
    return done.unionByName(repeated(many, run))


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS nxt FROM d WINDOW w AS (ORDER BY doc_id NULLS FIRST, left(md5(text), 8), text)),
e AS (SELECT doc_id, text, nxt, length(text) AS n_chars, left(text, length(text) - length(text) // 4) || left(nxt, length(text) // 4) AS edited FROM n),
v AS (SELECT *, [list_transform(string_split(x, chr(10)), lambda p: list_transform(regexp_extract_all(p, '{LEAF}'), lambda c: left(md5(c), 16))) FOR x IN [text, edited, nxt]] AS trees FROM e),
h AS (SELECT *, [[md5(array_to_string(p, '')) FOR p IN t] FOR t IN trees] AS ps, [list_distinct(flatten(t)) FOR t IN trees] AS ls FROM v),
r AS (SELECT *, [md5(array_to_string([md5(array_to_string(p[i * {SECTION} + 1:i * {SECTION} + {SECTION}], '')) FOR i IN range(0, (len(p) - 1) // {SECTION} + 1)], '')) FOR p IN ps] AS roots FROM h)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, roots[1] AS fingerprint, roots[2] AS edited_fingerprint,
  CASE WHEN roots[1] = roots[2] THEN 1.0::DOUBLE ELSE len(list_intersect(ls[1], ls[2])) * 2.0::DOUBLE / greatest(len(ls[1]) + len(ls[2]), 1) END AS near_edited,
  CASE WHEN roots[1] = roots[3] THEN 1.0::DOUBLE ELSE len(list_intersect(ls[1], ls[3])) * 2.0::DOUBLE / greatest(len(ls[1]) + len(ls[3]), 1) END AS near_next,
  list_position([ps[1][i] IS NOT DISTINCT FROM ps[2][i] FOR i IN range(1, greatest(len(ps[1]), len(ps[2])) + 1)], false)::BIGINT - 1 AS edited_paragraph
FROM r
"""
