"""Request-text operators over a column of texts.

Built-in JVM column expressions (regex, arrays, higher-order functions) over whole
texts, and one Arrow batch function for the TF-IDF router (T1/T2): it is fitted from
the fixed example phrases (a few hundred terms), and the terms of a batch of texts,
as integer codes, are multiplied with its weights at once. No join, no shuffle, and
no Python for single rows.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens import catalog
from cohortlens.functions.stopwords import ENGLISH

TOKEN_RE = r"\b\w\w+\b"
ID_RE = r"(?i)\b(C\d{4,})\b"


def _arr(xs) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def _contains_any(text: Column, words) -> Column:
    """Whether a text holds any of the words: one alternation instead of a test a word."""

    return text.rlike("|".join(re.escape(w) for w in words))


# ---------------------------------------------------------------- X1-X7
def normalize_query(c: Column) -> Column:
    """Lower, trim, non ``[a-z0-9\\s_]`` → space, collapse spaces, trim."""

    x = F.regexp_replace(F.trim(F.lower(c)), r"[^a-z0-9\s_]", " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def normalize_log_key(c: Column) -> Column:
    """Lower + collapse whitespace (punctuation kept)."""

    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def extract_customer_id(c: Column) -> Column:
    """First ``C\\d{4,}`` token (case-insensitive), upper-cased; none → NULL."""

    v = F.regexp_extract(c, ID_RE, 1)
    return F.when(v == "", F.lit(None).cast("string")).otherwise(F.upper(v))


def extract_cluster_count(norm: Column) -> Column:
    """``(\\d+)\\s*(clusters?|segments?)``, else ``(cluster|segment)\\b.*?(\\d+)``."""

    a = F.regexp_extract(norm, r"(\d+)\s*(?:clusters?|segments?)", 1)
    b = F.regexp_extract(norm, r"(?:cluster|segment)\b.*?(\d+)", 1)
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))).try_cast("bigint")


def has_digit(c: Column) -> Column:
    """X6."""

    return F.coalesce(c.rlike(r"\d"), F.lit(False))


def tokens(norm: Column) -> Column:
    """Whitespace tokens of a normalised text (empty text → empty array)."""

    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(norm, " "))


# ---------------------------------------------------------------- T4-T7, T10-T12
def _present(*hits: Column) -> Column:
    """The non-null ones of some different values, in order. (``filter`` with a lambda
    would interpret all its arguments row by row; this one is compiled with them.)"""

    return F.array_except(F.array(*hits), F.array(F.lit(None).cast("string")))


def entities(norm: Column) -> Column:
    """Entity tags by substring."""

    return _present(
        F.when(_contains_any(norm, catalog.SEGMENTATION_KEYWORDS), F.lit("customer_clusters")),
        F.when(_contains_any(norm, catalog.DESCRIPTIVE_KEYWORDS), F.lit("dataset_summary")),
        F.when(F.instr(norm, "recommend") > 0, F.lit("recommendations")),
        F.when(_contains_any(norm, ["visual", "chart", "plot"]), F.lit("visualization")),
    )


def output_format(norm: Column) -> Column:
    """Chart if a chart word is a substring, else table."""

    return F.when(_contains_any(norm, catalog.CHART_WORDS), F.lit("chart")).otherwise(F.lit("table"))


def with_normalized(docs: DataFrame, text_col: str, norm_col: str = "normalized_query", token_col: str = "tokens_") -> DataFrame:
    """Add the normalised text and its tokens as columns, each worked out once a row.
    An expression over ``normalize_query`` repeats it wherever it is used; these columns
    are projections of their own, which the optimiser does not merge into their users."""

    return docs.withColumn(norm_col, normalize_query(F.col(text_col))).withColumn(token_col, tokens(F.col(norm_col)))


def keyword_intent(norm: Column, t: Column | None = None) -> Column:
    """T4: explanation-only / eda-only / full workflow from token sets; ``t``: the text's
    tokens, where they are a column already."""

    t = tokens(norm) if t is None else t
    ex = F.arrays_overlap(t, _arr(catalog.EXPLANATION_KEYWORDS))
    eda = F.arrays_overlap(t, _arr(catalog.EDA_KEYWORDS))
    ex, eda = F.coalesce(ex, F.lit(False)), F.coalesce(eda, F.lit(False))
    return F.when(ex & ~eda, F.lit("explanation_only")).when(eda & ~ex, F.lit("eda_only")).otherwise(F.lit("full_workflow"))


def subjective_assumption(raw: Column) -> Column:
    """Assumption sentence for the first subjective term, unless a digit is present."""

    low = F.lower(F.coalesce(raw, F.lit("")))
    term = None
    for t in catalog.SUBJECTIVE_TERMS:
        term = F.when(F.instr(low, t) > 0, F.lit(t)) if term is None else term.when(F.instr(low, t) > 0, F.lit(t))
    sent = F.replace(F.lit(catalog.SUBJECTIVE_ASSUMPTION), F.lit("{term}"), term)
    return F.when(has_digit(low), F.lit(None).cast("string")).otherwise(sent)


def infer_intent(norm: Column, score: Column, category: Column) -> Column:
    """Customer id → explanation; score < threshold → descriptive; else class."""

    has_id = F.coalesce(norm.rlike(ID_RE), F.lit(False))
    return (
        F.when(has_id, F.lit("explanation"))
        .when(score < F.lit(catalog.SEMANTIC_SIMILARITY_THRESHOLD), F.lit("descriptive"))
        .when(category.isin("segmentation", "explanation"), category)
        .otherwise(F.lit("descriptive"))
    )


def fallback_workflow(intent: Column, kw: Column) -> tuple[Column, Column]:
    """T5: (workflow name, steps)."""

    name = (
        F.when((intent == "explanation") | (kw == "explanation_only"), F.lit("explanation_only"))
        .when((intent == "descriptive") | (kw == "eda_only"), F.lit("eda_only"))
        .when(intent == "segmentation", F.lit("full_workflow"))
        .otherwise(F.lit("eda_only"))
    )
    steps = (
        F.when(name == "explanation_only", F.array().cast("array<string>"))
        .when(name == "full_workflow", _arr(catalog.STEPS_SEGMENTATION))
        .otherwise(_arr(catalog.STEPS_DESCRIPTIVE))
    )
    return name, steps


def tools_for_intent(intent: Column, raw: Column) -> Column:
    """Tool names per routed intent; explanation tool by presence of an id."""

    has_id = F.coalesce(raw.rlike(ID_RE), F.lit(False))
    return (
        F.when(intent == "segmentation", _arr([catalog.TOOL_FEATURE_ENGINEERING, catalog.TOOL_SEGMENTATION, catalog.TOOL_RECOMMENDATION]))
        .when(intent == "explanation", F.array(F.when(has_id, F.lit(catalog.TOOL_CUSTOMER_LOOKUP)).otherwise(F.lit(catalog.TOOL_SEGMENT_EXPLAINER))))
        .otherwise(_arr([catalog.TOOL_EDA]))
    )


# ---------------------------------------------------------------- T8 filters
def filter_support(columns: list[str]) -> dict[str, bool]:
    """Which filter domains a dataset supports (schema metadata, no job)."""

    cols = [c.lower() for c in columns]
    out = {}
    for domain, _ in catalog.FILTER_DOMAINS:
        words = [w for w in re.findall(r"[a-z]+", domain.lower()) if len(w) > 2]
        out[domain] = any(w in col for col in cols for w in words)
    return out


def unsupported_filters(norm: Column, columns: list[str], t: Column | None = None) -> Column:
    """Requested filter domains (token hits, domain order) that no column supports."""

    support = filter_support(columns)
    t = tokens(norm) if t is None else t
    hits = [F.when(F.arrays_overlap(t, _arr(words)) & F.lit(not support[d]), F.lit(d)) for d, words in catalog.FILTER_DOMAINS]
    return _present(*hits)


def requested_filters(norm: Column, t: Column | None = None) -> Column:
    t = tokens(norm) if t is None else t
    hits = [F.when(F.arrays_overlap(t, _arr(words)), F.lit(d)) for d, words in catalog.FILTER_DOMAINS]
    return _present(*hits)


# ---------------------------------------------------------------- T1 / T2 TF-IDF router
def terms(norm: Column, stop: list[str] = ENGLISH) -> Column:
    """Uni- and bigrams after stop-word removal (token pattern ``\\b\\w\\w+\\b``).

    Bigrams pair the token array with itself shifted by one (``zip_with``);
    higher-order-function arguments are evaluated once per row, so the regex
    runs once per text. Use it directly inside ``explode`` (the generator's
    input is evaluated once per input row)."""

    toks = F.filter(F.regexp_extract_all(norm, F.lit(TOKEN_RE), 0), lambda x: ~x.isin(stop))
    pairs = F.zip_with(toks, F.slice(toks, 2, F.greatest(F.size(toks), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(toks, F.filter(pairs, lambda x: x.isNotNull()))


def _examples(spark: SparkSession) -> DataFrame:
    rows = []
    for ci, (cat, phrases) in enumerate(catalog.INTENT_EXAMPLES.items()):
        for j, p in enumerate(phrases):
            rows.append((ci, cat, j, p))
    df = spark.createDataFrame(rows, "cat_order int, category string, ex_idx int, phrase string")
    return df.withColumn("example", normalize_query(F.col("phrase")))


_PARAMS: dict = {}


def model_params(spark: SparkSession, stop: list[str] = ENGLISH) -> dict:
    """The fitted router as plain values.

    Spark tokenises and counts terms per example phrase (one aggregation; the
    result is bounded by the fixed phrases, ~200 rows). The smooth idf
    ``ln((1+n)/(1+df)) + 1``, L2 normalisation and class centroids are then
    parameter arithmetic over those counts."""

    key = (spark.sparkContext.applicationId, tuple(stop))
    if key in _PARAMS:
        return _PARAMS[key]
    ex = _examples(spark)
    rows = ex.select("cat_order", "category", "ex_idx", "example", F.explode_outer(terms(F.col("example"), stop)).alias("term")) \
        .groupBy("cat_order", "category", "ex_idx", "example", "term").agg(F.count(F.lit(1)).alias("tf")).collect()
    exs: dict = {}
    for r in rows:
        e = exs.setdefault((r["category"], r["ex_idx"]), {"example": r["example"], "order": r["cat_order"], "tf": {}})
        if r["term"] is not None:
            e["tf"][r["term"]] = float(r["tf"])
    n = float(len(exs))
    df: dict = {}
    for e in exs.values():
        for t in e["tf"]:
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log((1.0 + n) / (1.0 + d)) + 1.0 for t, d in df.items()}
    cats: dict = {}
    for (cat, _), e in exs.items():
        w = {t: c * idf[t] for t, c in e["tf"].items()}
        nrm = math.sqrt(sum(v * v for v in w.values())) or 1.0
        e["terms"] = {t: v / nrm for t, v in w.items()}
        c = cats.setdefault(cat, {"order": e["order"], "terms": {}, "n": 0})
        c["n"] += 1
        for t, v in e["terms"].items():
            c["terms"][t] = c["terms"].get(t, 0.0) + v
    for c in cats.values():
        c["terms"] = {t: v / c["n"] for t, v in c["terms"].items()}
        c["cn"] = math.sqrt(sum(v * v for v in c["terms"].values()))
    out = {"idf": idf, "categories": sorted(cats.items(), key=lambda kv: kv[1]["order"]),
           "examples": sorted(exs.items(), key=lambda kv: (kv[1]["order"], kv[0][1]))}
    _PARAMS[key] = out
    return out


class Router:
    """The fitted router as arrays, one row a vocabulary term: its idf, and its weight in
    every class centroid (divided by the centroid's norm at the end) and every example.
    About 200 terms by 40 columns, whatever the number of texts; a task gets it once."""

    #: Texts scored at once: at most PIECE * terms * columns products (about 30 MB).
    PIECE = 512

    def __init__(self, params: dict):
        self.vocabulary = sorted(params["idf"])
        at = {t: i for i, t in enumerate(self.vocabulary)}
        self.idf = np.array([params["idf"][t] for t in self.vocabulary])
        self.categories = [cat for cat, _ in params["categories"]]
        self.norms = np.array([c["cn"] for _, c in params["categories"]])
        self.examples = [e["example"] for _, e in params["examples"]]
        self.owner = np.array([self.categories.index(cat) for (cat, _), _ in params["examples"]])
        self.weights = np.zeros((len(at), len(self.categories) + len(self.examples)))
        for j, (_, c) in enumerate([*params["categories"], *params["examples"]]):
            for t, v in c["terms"].items():
                self.weights[at[t], j] = v

    def unit(self, terms: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, code, w): the unit vectors of texts given by their vocabulary terms, text
        by text in order of first occurrence. A null list has no terms."""

        size = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False)
        code = pc.index_in(terms.flatten(), value_set=pa.array(self.vocabulary)).to_numpy(zero_copy_only=False)
        key = np.repeat(np.arange(len(terms)), size) * len(self.vocabulary) + code
        key, first, n = np.unique(key.astype(np.int64), return_index=True, return_counts=True)
        order = np.argsort(first)
        text, code = np.divmod(key[order], len(self.vocabulary))
        w = n[order] * self.idf[code]
        start = np.flatnonzero(np.diff(text, prepend=-1))
        norm = np.sqrt(np.add.reduceat(w * w, start)) if len(w) else w
        return text, code, w / np.repeat(norm, np.diff(start, append=len(w)))

    def best(self, terms: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, score, example) of each text; class -1 where no class scores above 0."""

        found, score, example = np.full(len(terms), -1), np.zeros(len(terms)), np.zeros(len(terms), dtype=np.int64)
        for i in range(0, len(terms), self.PIECE):
            text, code, w = self.unit(terms.slice(i, self.PIECE))
            if not len(w):
                continue
            start = np.flatnonzero(np.diff(text, prepend=-1))
            dots = np.add.reduceat(w[:, None] * self.weights[code], start, axis=0)
            classes = dots[:, : len(self.categories)] / self.norms
            one = classes.argmax(axis=1)
            top = classes[np.arange(len(one)), one]
            own = np.where(self.owner[None, :] == one[:, None], dots[:, len(self.categories) :], -1.0)
            at = i + text[start]
            found[at], score[at], example[at] = np.where(top > 0, one, -1), top, own.argmax(axis=1)
        return found, score, example


def _known_terms(norm: Column, params: dict) -> Column:
    """The text's terms that the vocabulary holds (a hash set lookup each)."""

    return F.filter(terms(norm), lambda t: t.isin(sorted(params["idf"])))


def tfidf_vectors(docs: DataFrame, id_col: str, norm_col: str, params: dict | None = None) -> DataFrame:
    """Unit TF-IDF vectors of the request texts as (id, term, w) rows, in order of
    first occurrence; narrow projections plus an explode (no join, no shuffle)."""

    params = params or model_params(docs.sparkSession)
    router = Router(params)

    @F.arrow_udf("array<struct<code:int,w:double>>")
    def unit(found: pa.Array) -> pa.Array:
        text, code, w = router.unit(found)
        ends = np.searchsorted(text, np.arange(len(found) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(code.astype(np.int32)), pa.array(w)], ["code", "w"]))

    vectors = docs.select(id_col, F.inline(unit(_known_terms(F.col(norm_col), params))))
    return vectors.select(id_col, F.element_at(F.lit(router.vocabulary), F.col("code") + 1).alias("term"), "w")


def classify_semantic(docs: DataFrame, id_col: str, norm_col: str, params: dict | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Best class by cosine to the class centroid (strictly greater wins,
    class order breaks ties), score to 4 decimals, best example inside the
    class; ``keep`` carries columns through; no positive score → ('descriptive', 0.0, '').

    Terms are found by built-in functions; an Arrow batch of them is coded and multiplied
    with the router's weights at once. No join, no shuffle, linear in the texts."""

    from cohortlens.functions.expr import round_half_up

    params = params or model_params(docs.sparkSession)
    router = Router(params)

    @F.arrow_udf("struct<class:int,score:double,example:int>")
    def best(found: pa.Array) -> pa.Array:
        cls, score, example = router.best(found)
        return pa.StructArray.from_arrays([pa.array(cls.astype(np.int32)), pa.array(score), pa.array(example.astype(np.int32))], ["class", "score", "example"])

    scored = docs.select(id_col, *keep, best(_known_terms(F.col(norm_col), params)).alias("__b"))
    none = F.col("__b.class") < 0
    return scored.select(
        id_col,
        *keep,
        F.when(none, F.lit("descriptive")).otherwise(F.element_at(F.lit(router.categories), F.col("__b.class") + 1)).alias("category"),
        F.when(none, F.lit(0.0)).otherwise(round_half_up(F.col("__b.score"), 4)).alias("similarity_score"),
        F.when(none, F.lit("")).otherwise(F.element_at(F.lit(router.examples), F.col("__b.example") + 1)).alias("matched_example"),
    )


# ---------------------------------------------------------------- T9 ambiguity, T13 context
def intent_signal(norm: Column, score: Column, matched: Column, t: Column | None = None) -> Column:
    t = tokens(norm) if t is None else t
    kw = F.coalesce(F.arrays_overlap(t, _arr(sorted(set(catalog.SEGMENTATION_KEYWORDS + catalog.BUSINESS_INTENT_KEYWORDS + catalog.DESCRIPTIVE_KEYWORDS)))), F.lit(False))
    phrase = _contains_any(norm, catalog.BUSINESS_INTENT_PHRASES)
    generic = _arr(catalog.GENERIC_INTENT_TOKENS)
    qt = F.array_except(t, generic)
    et = F.array_except(tokens(normalize_query(matched)), generic)
    overlap = F.size(F.array_intersect(qt, et)) > 0
    return kw | phrase | ((score >= F.lit(catalog.SEMANTIC_SIMILARITY_THRESHOLD)) & overlap)


def ambiguity(norm: Column, score: Column, matched: Column, unsupported: Column, n_clusters: Column, t: Column | None = None) -> Column:
    """Clarification reason (query_too_vague / unsupported_filters_only /
    threshold_ambiguity) or NULL."""

    t = tokens(norm) if t is None else t
    sig = intent_signal(norm, score, matched, t)
    vague = (F.size(t) < 3) & ~sig
    resolvable = sig | n_clusters.isNotNull()
    unsup = (F.size(unsupported) > 0) & ~resolvable
    tier = F.coalesce(F.arrays_overlap(t, _arr(catalog.RULE_ENGINE_TIER_NAMES)), F.lit(False))
    thresh = ~tier & ~has_digit(norm) & _contains_any(norm, catalog.THRESHOLD_PHRASES)
    return (
        F.when(vague, F.lit("query_too_vague"))
        .when(unsup, F.lit("unsupported_filters_only"))
        .when(thresh, F.lit("threshold_ambiguity"))
    )


def build_context(requests: DataFrame, id_col: str, text_col: str, dataset_columns: list[str], params: dict | None = None) -> DataFrame:
    """One routing record per request."""

    base = with_normalized(requests.select(id_col, F.col(text_col).alias("raw_query")), "raw_query")
    df = classify_semantic(base, id_col, "normalized_query", params, keep=("raw_query", "normalized_query", "tokens_"))
    n, t = F.col("normalized_query"), F.col("tokens_")
    df = df.select(
        "*",
        infer_intent(n, F.col("similarity_score"), F.col("category")).alias("intent"),
        entities(n).alias("entities"),
        extract_cluster_count(n).alias("n_clusters"),
        output_format(n).alias("output_format"),
        unsupported_filters(n, dataset_columns, t).alias("unsupported_filters"),
        extract_customer_id(F.col("raw_query")).alias("customer_id"),
        keyword_intent(n, t).alias("keyword_intent"),
        subjective_assumption(F.col("raw_query")).alias("operational_assumption"),
    )
    wf, steps = fallback_workflow(F.col("intent"), F.col("keyword_intent"))
    from cohortlens.operators.personas import persona_from_text

    return df.select(
        "*",
        wf.alias("workflow"),
        steps.alias("steps"),
        tools_for_intent(F.col("intent"), F.col("raw_query")).alias("tools"),
        persona_from_text(F.col("raw_query")).alias("target_persona"),
        ambiguity(n, F.col("similarity_score"), F.col("matched_example"), F.col("unsupported_filters"), F.col("n_clusters"), t).alias("clarification"),
    ).drop("tokens_")

