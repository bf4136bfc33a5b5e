"""Request-text queries over every user turn of ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens import catalog
from cohortlens.functions.stopwords import ENGLISH
from cohortlens.operators import text as X
from cohortlens.operators.personas import persona_from_text
from cohortlens.plans.common import r4, rounded
from cohortlens.plans.registry import register
from cohortlens.sources.querylog import load_requests, requests_sql

DATASET_COLUMNS = catalog.REQUIRED_COLUMNS


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(_q(x) for x in xs) + "]"


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(trim(lower({x})), '[^a-z0-9\\s_]', ' ', 'g'), '\\s+', ' ', 'g'))"


def tokens_sql(n: str) -> str:
    return f"(CASE WHEN {n} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split({n}, ' ') END)"


def contains_any_sql(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {_q(w)})" for w in words) + ")"


def overlap_sql(t: str, words) -> str:
    return f"(len(list_intersect({t}, {_list(words)})) > 0)"


STOP = _list(ENGLISH)


def terms_sql(n: str) -> str:
    t = f"list_filter(regexp_extract_all({n}, '\\b\\w\\w+\\b'), lambda x: NOT list_contains({STOP}, x))"
    return (
        f"list_concat({t}, CASE WHEN len({t}) >= 2 THEN list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1]) "
        f"ELSE CAST([] AS VARCHAR[]) END)"
    )


_EX_VALUES = ", ".join(
    f"({ci}, {_q(cat)}, {j}, {_q(p)})" for ci, (cat, ps) in enumerate(catalog.INTENT_EXAMPLES.items()) for j, p in enumerate(ps)
)

REQ_CTE = "WITH req AS (SELECT id AS request_id, query_text AS raw_query, " + norm_sql("query_text") + " AS nq FROM (" + requests_sql() + "))"

TFIDF_CTE = REQ_CTE + f""",
ex AS (SELECT * FROM (VALUES {_EX_VALUES}) AS t(cat_order, category, ex_idx, phrase)),
exn AS (SELECT *, {norm_sql('phrase')} AS example FROM ex),
exterms AS (SELECT cat_order, category, ex_idx, example, unnest({terms_sql('example')}) AS term FROM exn),
exf AS (SELECT cat_order, category, ex_idx, example, term, CAST(count(*) AS DOUBLE) AS tf FROM exterms GROUP BY ALL),
nex AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM ex),
vocab AS (SELECT term, ln((1.0 + n) / (1.0 + count(*))) + 1.0 AS idf FROM exf, nex GROUP BY term, n),
exw AS (SELECT exf.*, tf * idf AS w FROM exf JOIN vocab USING (term)),
exnrm AS (SELECT category, ex_idx, sqrt(sum(w * w)) AS nrm FROM exw GROUP BY ALL),
exv AS (SELECT cat_order, category, ex_idx, example, term, w / nrm AS w FROM exw JOIN exnrm USING (category, ex_idx)),
sizes AS (SELECT category, count(*) AS n_ex FROM ex GROUP BY category),
cen AS (SELECT cat_order, category, term, sum(w) / n_ex AS c FROM exv JOIN sizes USING (category) GROUP BY cat_order, category, term, n_ex),
cnrm AS (SELECT category, sqrt(sum(c * c)) AS cn FROM cen GROUP BY category),
rterms AS (SELECT request_id, unnest({terms_sql('nq')}) AS term FROM req),
qtf AS (SELECT request_id, term, idf, CAST(count(*) AS DOUBLE) AS tf FROM rterms JOIN vocab USING (term) GROUP BY ALL),
qn AS (SELECT request_id, sqrt(sum((tf * idf) * (tf * idf))) AS nrm FROM qtf GROUP BY ALL),
qv AS (SELECT request_id, term, tf * idf / nrm AS w FROM qtf JOIN qn USING (request_id)),
sc AS (SELECT request_id, cat_order, category, sum(w * c) / cn AS score FROM qv JOIN cen USING (term) JOIN cnrm USING (category)
       GROUP BY request_id, cat_order, category, cn HAVING sum(w * c) / cn > 0),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, cat_order) AS rn FROM sc) WHERE rn = 1),
exs AS (SELECT q.request_id, e.category, e.ex_idx, sum(q.w * e.w) AS es FROM qv q JOIN exv e USING (term) GROUP BY ALL),
bex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, category ORDER BY es DESC, ex_idx) AS rn FROM exs) WHERE rn = 1),
sem AS (SELECT r.request_id, r.raw_query, r.nq, coalesce(b.category, 'descriptive') AS category,
               coalesce({r4('b.score')}, 0.0) AS similarity_score,
               CASE WHEN b.category IS NULL THEN '' ELSE e.example END AS matched_example
        FROM req r LEFT JOIN best b ON b.request_id = r.request_id
        LEFT JOIN bex x ON x.request_id = r.request_id AND x.category = b.category
        LEFT JOIN exn e ON e.category = b.category AND e.ex_idx = coalesce(x.ex_idx, 0))"""


def _support_sql() -> dict[str, bool]:
    return X.filter_support(DATASET_COLUMNS)


def unsupported_sql(t: str) -> str:
    sup = _support_sql()
    parts = [f"CASE WHEN {overlap_sql(t, words)} AND {'false' if sup[d] else 'true'} THEN {_q(d)} END" for d, words in catalog.FILTER_DOMAINS]
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


def requested_sql(t: str) -> str:
    parts = [f"CASE WHEN {overlap_sql(t, words)} THEN {_q(d)} END" for d, words in catalog.FILTER_DOMAINS]
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


def n_clusters_sql(n: str) -> str:
    a = f"nullif(regexp_extract({n}, '(\\d+)\\s*(?:clusters?|segments?)', 1), '')"
    b = f"nullif(regexp_extract({n}, '(?:cluster|segment)\\b.*?(\\d+)', 1), '')"
    return f"TRY_CAST(coalesce({a}, {b}) AS BIGINT)"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_requests(spark, sf_dir)


# ---- normalize_text (X1, X2, X7, X6) -------------------------------------------------
@register(
    "normalize_text",
    REQ_CTE + f""" SELECT request_id, nq AS normalized_query,
  trim(regexp_replace(lower(raw_query), '\\s+', ' ', 'g')) AS log_key,
  CAST(len({tokens_sql('nq')}) AS INTEGER) AS token_count, regexp_matches(nq, '\\d') AS has_digit FROM req""",
)
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = X.with_normalized(requests(spark, sf_dir), "query_text", "nq")
    n = F.col("nq")
    return r.select(
        "request_id", n.alias("normalized_query"), X.normalize_log_key(F.col("query_text")).alias("log_key"),
        F.size("tokens_").alias("token_count"), X.has_digit(n).alias("has_digit"),
    )


# ---- extract_ids (X4) ------------------------------------------------------------------
@register(
    "extract_ids",
    REQ_CTE + """ SELECT request_id, upper(nullif(regexp_extract(raw_query, '(?i)\\b(C\\d{4,})\\b', 1), '')) AS customer_id,
  upper(nullif(regexp_extract(nq, '(?i)\\b(C\\d{4,})\\b', 1), '')) AS customer_id_normalized FROM req""",
)
def extract_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = requests(spark, sf_dir)
    return r.select(
        "request_id", X.extract_customer_id(F.col("query_text")).alias("customer_id"),
        X.extract_customer_id(X.normalize_query(F.col("query_text"))).alias("customer_id_normalized"),
    )


# ---- extract_cluster_count (X5) ------------------------------------------------------------
@register("extract_cluster_count", REQ_CTE + f" SELECT request_id, {n_clusters_sql('nq')} AS n_clusters FROM req")
def extract_cluster_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = requests(spark, sf_dir)
    return r.select("request_id", X.extract_cluster_count(X.normalize_query(F.col("query_text"))).alias("n_clusters"))


# ---- unsupported_filters (T8, J9, U3) -------------------------------------------------------
@register(
    "unsupported_filters",
    REQ_CTE + f""", tk AS (SELECT request_id, {tokens_sql('nq')} AS t FROM req)
SELECT request_id, array_to_string({requested_sql('t')}, '|') AS requested, array_to_string({unsupported_sql('t')}, '|') AS unsupported FROM tk""",
)
def unsupported_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = X.with_normalized(requests(spark, sf_dir), "query_text", "nq")
    n, t = F.col("nq"), F.col("tokens_")
    return r.select(
        "request_id", F.array_join(X.requested_filters(n, t), "|").alias("requested"),
        F.array_join(X.unsupported_filters(n, DATASET_COLUMNS, t), "|").alias("unsupported"),
    )


# ---- keyword_intent (T4, T6, T7) -------------------------------------------------------------
def _kw_sql(t: str) -> str:
    ex = overlap_sql(t, catalog.EXPLANATION_KEYWORDS)
    eda = overlap_sql(t, catalog.EDA_KEYWORDS)
    return f"CASE WHEN {ex} AND NOT {eda} THEN 'explanation_only' WHEN {eda} AND NOT {ex} THEN 'eda_only' ELSE 'full_workflow' END"


def _entities_sql(n: str) -> str:
    return (
        f"array_to_string(list_filter([CASE WHEN {contains_any_sql(n, catalog.SEGMENTATION_KEYWORDS)} THEN 'customer_clusters' END, "
        f"CASE WHEN {contains_any_sql(n, catalog.DESCRIPTIVE_KEYWORDS)} THEN 'dataset_summary' END, "
        f"CASE WHEN contains({n}, 'recommend') THEN 'recommendations' END, "
        f"CASE WHEN {contains_any_sql(n, ['visual', 'chart', 'plot'])} THEN 'visualization' END], lambda x: x IS NOT NULL), '|')"
    )


@register(
    "keyword_intent",
    REQ_CTE + f""", tk AS (SELECT request_id, nq, {tokens_sql('nq')} AS t FROM req)
SELECT request_id, {_kw_sql('t')} AS keyword_intent, {_entities_sql('nq')} AS entities,
  CASE WHEN {contains_any_sql('nq', catalog.CHART_WORDS)} THEN 'chart' ELSE 'table' END AS output_format FROM tk""",
)
def keyword_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = X.with_normalized(requests(spark, sf_dir), "query_text", "nq")
    n = F.col("nq")
    return r.select(
        "request_id", X.keyword_intent(n, F.col("tokens_")).alias("keyword_intent"), F.array_join(X.entities(n), "|").alias("entities"),
        X.output_format(n).alias("output_format"),
    )


# ---- infer_persona (T11, T10) ---------------------------------------------------------------------
def _persona_sql(x: str) -> str:
    low = f"lower(coalesce({x}, ''))"
    whens = " ".join(f"WHEN {contains_any_sql(low, words)} THEN {_q(p)}" for p, words in catalog.PERSONA_PHRASE_RULES)
    return f"CASE {whens} ELSE {_q(catalog.PERSONA_DEFAULT)} END"


def _assumption_sql(x: str) -> str:
    low = f"lower(coalesce({x}, ''))"
    term = "CASE " + " ".join(f"WHEN contains({low}, {_q(t)}) THEN {_q(t)}" for t in catalog.SUBJECTIVE_TERMS) + " END"
    return f"CASE WHEN regexp_matches({low}, '\\d') THEN NULL ELSE replace({_q(catalog.SUBJECTIVE_ASSUMPTION)}, '{{term}}', {term}) END"


@register(
    "infer_persona",
    REQ_CTE + f" SELECT request_id, {_persona_sql('raw_query')} AS target_persona, {_assumption_sql('raw_query')} AS operational_assumption FROM req",
)
def infer_persona(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = requests(spark, sf_dir)
    return r.select(
        "request_id", persona_from_text(F.col("query_text")).alias("target_persona"),
        X.subjective_assumption(F.col("query_text")).alias("operational_assumption"),
    )


# ---- tfidf_vectors (T1) and centroid_intent (T2, T3) ------------------------------------------------
@register("tfidf_vectors", TFIDF_CTE + f" SELECT request_id, term, {r4('w', 6)} AS weight FROM qv")
def tfidf_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = requests(spark, sf_dir).select("request_id", X.normalize_query(F.col("query_text")).alias("nq"))
    v = X.tfidf_vectors(r, "request_id", "nq")
    return rounded(v.select("request_id", "term", F.col("w").alias("weight")), 6)


def _intent_sql() -> str:
    return (
        f"CASE WHEN regexp_matches(nq, '(?i)\\bC\\d{{4,}}\\b') THEN 'explanation' "
        f"WHEN similarity_score < {catalog.SEMANTIC_SIMILARITY_THRESHOLD} THEN 'descriptive' "
        f"WHEN category IN ('segmentation', 'explanation') THEN category ELSE 'descriptive' END"
    )


@register(
    "centroid_intent",
    TFIDF_CTE + f" SELECT request_id, category, similarity_score, matched_example, {_intent_sql()} AS intent FROM sem",
)
def centroid_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = requests(spark, sf_dir).select("request_id", X.normalize_query(F.col("query_text")).alias("nq"))
    return X.classify_semantic(r, "request_id", "nq", keep=("nq",)).select(
        "request_id", "category", "similarity_score", "matched_example",
        X.infer_intent(F.col("nq"), F.col("similarity_score"), F.col("category")).alias("intent"),
    )


# ---- ambiguity (T9) ----------------------------------------------------------------------------------
def _ambiguity_sql() -> str:
    t = tokens_sql("nq")
    kw = sorted(set(catalog.SEGMENTATION_KEYWORDS + catalog.BUSINESS_INTENT_KEYWORDS + catalog.DESCRIPTIVE_KEYWORDS))
    gen = _list(catalog.GENERIC_INTENT_TOKENS)
    et = tokens_sql(norm_sql("matched_example"))
    overlap = f"len(list_intersect(list_filter({t}, lambda x: NOT list_contains({gen}, x)), list_filter({et}, lambda x: NOT list_contains({gen}, x)))) > 0"
    sig = f"({overlap_sql(t, kw)} OR {contains_any_sql('nq', catalog.BUSINESS_INTENT_PHRASES)} OR (similarity_score >= {catalog.SEMANTIC_SIMILARITY_THRESHOLD} AND {overlap}))"
    return (
        TFIDF_CTE
        + f""", amb AS (SELECT request_id, {t} AS t, nq, {sig} AS sig, {unsupported_sql(t)} AS unsup, {n_clusters_sql('nq')} AS nc FROM sem)
SELECT request_id, CASE WHEN len(t) < 3 AND NOT sig THEN 'query_too_vague'
  WHEN len(unsup) > 0 AND NOT (sig OR nc IS NOT NULL) THEN 'unsupported_filters_only'
  WHEN NOT {overlap_sql('t', catalog.RULE_ENGINE_TIER_NAMES)} AND NOT regexp_matches(nq, '\\d') AND {contains_any_sql('nq', catalog.THRESHOLD_PHRASES)}
  THEN 'threshold_ambiguity' END AS clarification FROM amb"""
    )


@register("ambiguity", _ambiguity_sql())
def ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = X.build_context(requests(spark, sf_dir), "request_id", "query_text", DATASET_COLUMNS)
    return ctx.select("request_id", "clarification")


# ---- request_context (T13, T5, T12) -------------------------------------------------------------------
def _context_sql() -> str:
    t = tokens_sql("nq")
    kw = sorted(set(catalog.SEGMENTATION_KEYWORDS + catalog.BUSINESS_INTENT_KEYWORDS + catalog.DESCRIPTIVE_KEYWORDS))
    gen = _list(catalog.GENERIC_INTENT_TOKENS)
    et = tokens_sql(norm_sql("matched_example"))
    overlap = f"len(list_intersect(list_filter({t}, lambda x: NOT list_contains({gen}, x)), list_filter({et}, lambda x: NOT list_contains({gen}, x)))) > 0"
    sig = f"({overlap_sql(t, kw)} OR {contains_any_sql('nq', catalog.BUSINESS_INTENT_PHRASES)} OR (similarity_score >= {catalog.SEMANTIC_SIMILARITY_THRESHOLD} AND {overlap}))"
    seg_tools = "|".join([catalog.TOOL_FEATURE_ENGINEERING, catalog.TOOL_SEGMENTATION, catalog.TOOL_RECOMMENDATION])
    return (
        TFIDF_CTE
        + f""", c1 AS (SELECT *, {t} AS t, {_intent_sql()} AS intent, {_kw_sql(t)} AS keyword_intent, {sig} AS sig,
                 {unsupported_sql(t)} AS unsup, {n_clusters_sql('nq')} AS n_clusters FROM sem),
c2 AS (SELECT *, CASE WHEN intent = 'explanation' OR keyword_intent = 'explanation_only' THEN 'explanation_only'
                      WHEN intent = 'descriptive' OR keyword_intent = 'eda_only' THEN 'eda_only'
                      WHEN intent = 'segmentation' THEN 'full_workflow' ELSE 'eda_only' END AS workflow FROM c1)
SELECT request_id, nq AS normalized_query, intent, category, similarity_score, matched_example, workflow,
  CASE workflow WHEN 'explanation_only' THEN '' WHEN 'full_workflow' THEN {_q('|'.join(catalog.STEPS_SEGMENTATION))}
       ELSE {_q('|'.join(catalog.STEPS_DESCRIPTIVE))} END AS steps,
  CASE intent WHEN 'segmentation' THEN {_q(seg_tools)}
       WHEN 'explanation' THEN CASE WHEN regexp_matches(raw_query, '(?i)\\bC\\d{{4,}}\\b') THEN {_q(catalog.TOOL_CUSTOMER_LOOKUP)}
                                    ELSE {_q(catalog.TOOL_SEGMENT_EXPLAINER)} END
       ELSE {_q(catalog.TOOL_EDA)} END AS tools,
  n_clusters, CASE WHEN {contains_any_sql('nq', catalog.CHART_WORDS)} THEN 'chart' ELSE 'table' END AS output_format,
  {_entities_sql('nq')} AS entities, array_to_string(unsup, '|') AS unsupported_filters,
  upper(nullif(regexp_extract(raw_query, '(?i)\\b(C\\d{{4,}})\\b', 1), '')) AS customer_id, keyword_intent,
  {_persona_sql('raw_query')} AS target_persona,
  CASE WHEN len(t) < 3 AND NOT sig THEN 'query_too_vague'
       WHEN len(unsup) > 0 AND NOT (sig OR n_clusters IS NOT NULL) THEN 'unsupported_filters_only'
       WHEN NOT {overlap_sql('t', catalog.RULE_ENGINE_TIER_NAMES)} AND NOT regexp_matches(nq, '\\d') AND {contains_any_sql('nq', catalog.THRESHOLD_PHRASES)}
       THEN 'threshold_ambiguity' END AS clarification
FROM c2"""
    )


@register("request_context", _context_sql())
def request_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = X.build_context(requests(spark, sf_dir), "request_id", "query_text", DATASET_COLUMNS)
    return ctx.select(
        "request_id", "normalized_query", "intent", "category", "similarity_score", "matched_example", "workflow",
        F.array_join("steps", "|").alias("steps"), F.array_join("tools", "|").alias("tools"), "n_clusters", "output_format",
        F.array_join("entities", "|").alias("entities"), F.array_join("unsupported_filters", "|").alias("unsupported_filters"),
        "customer_id", "keyword_intent", "target_persona", "clarification",
    )


# ---- clarifications (T9): the question that goes with a reason -----------------------------------------
def _clarifications_sql() -> str:
    cases = " ".join(
        f"WHEN {_q(k)} THEN replace({_q(v)}, '{{requested}}', replace(unsupported_filters, '|', ', '))" for k, v in catalog.AMBIGUITY_QUESTIONS.items())
    return (
        f"SELECT request_id, clarification, CASE clarification {cases} END AS question, "
        f"CASE WHEN unsupported_filters <> '' THEN {_q(catalog.UNSUPPORTED_FILTER_REASON)} END AS filter_reason FROM ({_context_sql()})"
    )


@register("clarifications", _clarifications_sql())
def clarifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = X.build_context(requests(spark, sf_dir), "request_id", "query_text", DATASET_COLUMNS)
    asked = F.array_join("unsupported_filters", ", ")
    question = F
    for reason, text in catalog.AMBIGUITY_QUESTIONS.items():
        question = question.when(F.col("clarification") == reason, F.replace(F.lit(text), F.lit("{requested}"), asked))
    return ctx.select(
        "request_id", "clarification", question.alias("question"),
        F.when(F.size("unsupported_filters") > 0, F.lit(catalog.UNSUPPORTED_FILTER_REASON)).alias("filter_reason"),
    )
