"""Persona mapping, summaries and target lists.

The persona catalog is a 4-row literal table (broadcast). Top-N per persona is
``row_number() … <= n``; Spark plans it with a partial ``WindowGroupLimit``
before the exchange, so even a persona holding a third of all customers
ships at most n rows per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens import catalog

LABEL = "cluster"


def persona_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        catalog.PERSONAS, "cluster int, persona string, persona_profile string, recommended_product string, sort_key string, sort_ascending boolean"
    )


def alias_table(spark: SparkSession) -> DataFrame:
    """Every accepted lower-case name or alias → cluster."""

    rows = dict(catalog.PERSONA_ALIASES)
    for cid, name, *_ in catalog.PERSONAS:
        rows.setdefault(name.lower(), cid)
    return spark.createDataFrame(sorted(rows.items()), "alias string, cluster int")


def resolve_persona(name: str) -> int:
    """M14 for one name (driver-side convenience): alias or name, case-insensitive."""

    key = name.strip().lower()
    if key in catalog.PERSONA_ALIASES:
        return catalog.PERSONA_ALIASES[key]
    for cid, pname, *_ in catalog.PERSONAS:
        if pname.lower() == key:
            return cid
    raise ValueError(f"Unknown persona '{name}'. Expected one of: {[p[1] for p in catalog.PERSONAS]}")


def resolve_persona_column(df: DataFrame, name_col: str) -> DataFrame:
    """M14 over a column of names: left join to the alias table (NULL = unknown)."""

    a = alias_table(df.sparkSession)
    return df.join(F.broadcast(a), F.lower(F.trim(F.col(name_col))) == F.col("alias"), "left").drop("alias")


def attach_personas(clustered: DataFrame, label_col: str = "cluster") -> DataFrame:
    """Label → persona, product, profile (broadcast 4-row catalog).
    Labels outside the catalog raise in the reference; here they get NULLs."""

    cat = persona_catalog(clustered.sparkSession).select(
        F.col("cluster").alias(label_col), "persona", "recommended_product", "persona_profile"
    )
    return clustered.join(F.broadcast(cat), label_col, "left")


def persona_summary(with_personas: DataFrame) -> DataFrame:
    """Customers per (cluster, persona, product)."""

    return with_personas.groupBy(LABEL, "persona", "recommended_product").agg(F.count(F.lit(1)).alias("customer_count"))


def _sort_value(df: DataFrame) -> Column:
    """Per-row sort value of its persona's key, oriented so that larger = first."""

    expr = None
    for cid, _, _, _, key, asc in catalog.PERSONAS:
        v = F.col(key).cast("double")
        v = -v if asc else v
        expr = F.when(F.col(LABEL) == cid, v) if expr is None else expr.when(F.col(LABEL) == cid, v)
    return expr


def persona_top_n(with_personas: DataFrame, top_n: int = 10) -> DataFrame:
    """W2 for all personas at once: top ``top_n`` by the persona's sort key and
    direction (ties → CUST_ID), with the key's value."""

    w = Window.partitionBy(LABEL).orderBy(F.desc("_sv"), F.asc("CUST_ID"))
    ranked = with_personas.withColumn("_sv", _sort_value(with_personas)).where(F.col("_sv").isNotNull())
    ranked = ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
    key_value = None
    for cid, _, _, _, key, _ in catalog.PERSONAS:
        v = F.col(key).cast("double")
        key_value = F.when(F.col(LABEL) == cid, v) if key_value is None else key_value.when(F.col(LABEL) == cid, v)
    key_name = None
    for cid, _, _, _, key, _ in catalog.PERSONAS:
        key_name = F.when(F.col(LABEL) == cid, F.lit(key)) if key_name is None else key_name.when(F.col(LABEL) == cid, F.lit(key))
    return ranked.select(LABEL, "persona", "rank", "CUST_ID", "recommended_product", key_name.alias("sort_key"), key_value.alias("sort_value"))


def top_customers_for_persona(with_personas: DataFrame, persona_name: str, top_n: int = 10) -> DataFrame:
    """W2 for one persona: filter (P7) then ``orderBy.limit`` (TakeOrderedAndProject)."""

    cid = resolve_persona(persona_name)
    _, name, _, _, key, asc = catalog.PERSONAS[cid]
    if LABEL in with_personas.columns:
        sub = with_personas.where(F.col(LABEL) == cid)
    else:
        sub = with_personas.where(F.lower("persona") == name.lower())
    order = F.asc(key) if asc else F.desc(key)
    return sub.orderBy(order, F.asc("CUST_ID")).limit(top_n)


INSIGHT_METRICS = [
    "BALANCE", "BALANCE_FREQUENCY", "PURCHASES", "CASH_ADVANCE", "CREDIT_LIMIT", "PAYMENTS", "MINIMUM_PAYMENTS",
    "PRC_FULL_PAYMENT", "PURCHASES_FREQUENCY", "CREDIT_UTILIZATION", "PAYMENT_RATIO", "INSTALLMENT_RATIO",
]


def customer_insight(with_personas: DataFrame, cust_id: str) -> DataFrame:
    """P6 + P15: one customer's persona fields and 12 metrics (NULL when absent)."""

    row = with_personas.where(F.col("CUST_ID").cast("string") == F.lit(str(cust_id))).orderBy("CUST_ID").limit(1)
    metrics = [(F.col(m).cast("double") if m in with_personas.columns else F.lit(None).cast("double")).alias(m) for m in INSIGHT_METRICS]
    return row.select(
        F.col("CUST_ID").cast("string").alias("cust_id"), F.col(LABEL).alias("cluster"), "persona", "persona_profile",
        "recommended_product", *metrics,
    )


def playbook_expr(persona: Column, product: Column) -> Column:
    """Persona playbook sentence, generic fallback."""

    expr = None
    for name, tmpl in catalog.PERSONA_PLAYBOOKS.items():
        sent = F.replace(F.replace(F.lit(tmpl), F.lit("{persona}"), persona), F.lit("{product}"), product)
        expr = F.when(persona == name, sent) if expr is None else expr.when(persona == name, sent)
    fb = F.replace(F.replace(F.lit(catalog.PERSONA_PLAYBOOK_FALLBACK), F.lit("{persona}"), persona), F.lit("{product}"), product)
    return expr.otherwise(fb)


def persona_from_text(text: Column) -> Column:
    """Business phrasing → persona (ordered substring rules, default Transactors)."""

    t = F.lower(F.coalesce(text, F.lit("")))
    expr = None
    for persona, words in catalog.PERSONA_PHRASE_RULES:
        cond = None
        for w in words:
            c = F.instr(t, w) > 0
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, F.lit(persona)) if expr is None else expr.when(cond, F.lit(persona))
    return expr.otherwise(F.lit(catalog.PERSONA_DEFAULT))


TARGET_COLUMNS = ["CUST_ID", "BALANCE", "PURCHASES", "CREDIT_LIMIT", "CREDIT_UTILIZATION"]


def target_table(with_personas: DataFrame, persona_name: str, top_n: int = 8) -> DataFrame:
    """D3: persona top-``top_n`` with the five display columns."""

    return top_customers_for_persona(with_personas, persona_name, top_n).select(*TARGET_COLUMNS)


def assign_by_profile(centers_scaled: list[list[float]], features: list[str]) -> dict[int, int]:
    """Profile-based persona mapping (one-to-one, greedy): highest PURCHASES →
    Transactors (0), highest BALANCE → Revolvers (1), highest CASH_ADVANCE →
    Cash-Advance (2), the rest → Dormant (3). Input: k ≤ 4 scaled centers."""

    order = [("PURCHASES", 0), ("BALANCE", 1), ("CASH_ADVANCE", 2)]
    free = set(range(len(centers_scaled)))
    mapping: dict[int, int] = {}
    for feat, persona in order:
        if not free:
            break
        i = features.index(feat)
        best = max(sorted(free), key=lambda c: centers_scaled[c][i])
        mapping[best] = persona
        free.discard(best)
    for c in sorted(free):
        mapping[c] = 3
    return mapping


def fit_personas(profile: DataFrame, k: int = 4, by_label: bool = False, n_init: int = catalog.KMEANS_RESTARTS,
                 seed: int = catalog.SEED) -> DataFrame:
    """E2 → E15-E17 → M1 (population std) → M3 k-means on the six persona
    columns → P13 persona attachment.

    Persona mapping: by default by profile (greedy on the scaled centers,
    see ``assign_by_profile``); ``by_label=True`` keeps the raw-label rule.
    k > 4 is an error (the catalog has four personas).
    """

    from cohortlens.operators.cluster import kmeans_fit
    from cohortlens.operators.features import persona_features
    from cohortlens.operators.scaling import standardize

    if k > len(catalog.PERSONAS):
        raise ValueError(f"the persona catalog has {len(catalog.PERSONAS)} entries; k={k} is not mappable")
    cols = catalog.PERSONA_CLUSTER_FEATURES
    pf = persona_features(profile)
    z = standardize(pf, cols, prefix="z_")
    zcols = [f"z_{c}" for c in cols]
    res = kmeans_fit(z, zcols, k, seed=seed, n_init=n_init, rank_by="z_PURCHASES")
    if by_label:
        mapping = {i: i for i in range(k)}
    else:
        mapping = assign_by_profile(res.centers, list(cols))
    m = F.create_map(*[x for a, b in mapping.items() for x in (F.lit(a), F.lit(b))])
    labels = res.labels.select("CUST_ID", F.element_at(m, F.col("cluster_label")).cast("int").alias(LABEL))
    return attach_personas(pf.join(labels, "CUST_ID"), LABEL)
