import duckdb
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside; a table may have them too.
CLASHING = ["score", "found", "rank", "h", "id_", "hub", "size", "key", "shard", "copies_", "hash_", "keep_", "fp", "y", "node", "range", "digest"]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""

    text = "Ther is and the onher of thing. Anred the tion of it!\nSecond line here, with some words? Yes."
    rows = [
        (1, text, "en", "a", 10), (2, text, "en", "b", 10), (3, None, "en", "a", None), (4, "", "de", "a", 0), (5, "12345 !!! 77", None, None, 3),
        (6, " \t\n ", "fr", "b", 4), (7, "word " * 4000 + "x" * 9000, "en", "a", 29000), (8, "été où ça là", "fr", "c", 12), (None, "kein id hier", "de", "c", 3),
        (9, "unseen wörds größe", "de", "c", 3), (1, text, "en", "a", 10), (10, text + " more", "en", None, 10), (11, "b", None, "c", 1),
    ]
    df = spark.createDataFrame(rows, DOCUMENTS)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def parity(spark):
    """Compare a query with SQL over the same tables: names, rows and values."""

    def compare(df, sql, **tables):
        con = duckdb.connect()
        for name, table in tables.items():
            if isinstance(table, str):
                con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{table}')")
            else:
                con.register(f"{name}_", table.toArrow())
                con.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_")
        got = con.execute(sql)
        names = [d[0] for d in got.description]
        assert sorted(names) == sorted(df.columns)

        def plain(v):
            return round(v, 6) if isinstance(v, float) else v

        want = sorted(repr([plain(v) for v in r]) for r in got.fetchall())
        have = sorted(repr([plain(v) for v in r]) for r in df.select(*names).collect())
        assert have == want
        return len(have)

    return compare
