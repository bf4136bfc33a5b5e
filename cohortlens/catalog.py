"""Catalogs and constants.

FIXED VALUES. Everything in this module is data that must equal the
behaviour being reproduced (column contracts, persona and product texts,
tier bundles, thresholds, routing phrase lists, feature labels). They are
listed plainly, in their natural order. Code elsewhere turns them into small
literal DataFrames or ``create_map`` expressions; none of them grows with the
data, so they are safe to broadcast.
"""

from __future__ import annotations

# --- customer profile contract (18 columns) -------------------------------
REQUIRED_COLUMNS = [
    "CUST_ID",
    "BALANCE",
    "BALANCE_FREQUENCY",
    "PURCHASES",
    "ONEOFF_PURCHASES",
    "INSTALLMENTS_PURCHASES",
    "CASH_ADVANCE",
    "PURCHASES_FREQUENCY",
    "ONEOFF_PURCHASES_FREQUENCY",
    "PURCHASES_INSTALLMENTS_FREQUENCY",
    "CASH_ADVANCE_FREQUENCY",
    "CASH_ADVANCE_TRX",
    "PURCHASES_TRX",
    "CREDIT_LIMIT",
    "PAYMENTS",
    "MINIMUM_PAYMENTS",
    "PRC_FULL_PAYMENT",
    "TENURE",
]

# --- engineered feature table (id + TENURE + 11 ratios) --------------------
FEATURE_COLUMNS = [
    "TENURE",
    "monthly_spend",
    "avg_purchase_ticket",
    "transaction_frequency_per_month",
    "cash_advance_ratio",
    "installment_purchase_share",
    "oneoff_purchase_share",
    "credit_utilization_ratio",
    "payment_to_minimum_ratio",
    "full_payment_ratio",
    "cash_advance_intensity",
    "credit_headroom",
]

# --- persona path -----------------------------------------------------------
PERSONA_CLUSTER_FEATURES = [
    "BALANCE",
    "PURCHASES",
    "CASH_ADVANCE",
    "CREDIT_UTILIZATION",
    "PAYMENT_RATIO",
    "PURCHASES_FREQUENCY",
]

# (cluster, persona, profile, product, sort key, ascending)
PERSONAS = [
    (0, "The Transactors", "High Purchases, High Full Payments",
     "High-End Premium Travel Rewards Card", "PURCHASES", False),
    (1, "The Revolvers", "High Balance, Low Payment Ratio",
     "Balance Transfer Card / Debt Consolidation Loan", "BALANCE", False),
    (2, "Cash-Advance Reliant", "High Cash Advance, Low Purchases",
     "Low-fee Personal Loan / Overdraft Protection", "CASH_ADVANCE", False),
    (3, "Dormant / Low Activity", "Low Balance Frequency, Low Purchases",
     "Zero-fee Basic Checking / First-purchase Cashback Offer", "BALANCE_FREQUENCY", True),
]

PERSONA_ALIASES = {
    "transactors": 0,
    "the transactors": 0,
    "revolvers": 1,
    "the revolvers": 1,
    "cash-advance reliant": 2,
    "cash advance reliant": 2,
    "dormant": 3,
    "dormant / low activity": 3,
    "low activity": 3,
}

# Persona playbook sentences; {persona} and {product} are filled per row.
PERSONA_PLAYBOOKS = {
    "The Transactors": (
        "Prioritize premium acquisition messaging for '{persona}'. Lead with "
        "{product}, highlight travel/lifestyle rewards, and invite cardholders "
        "with strong repayment behaviour into a concierge upgrade path."
    ),
    "The Revolvers": (
        "For '{persona}', lead with debt relief: position {product} as a lower-cost "
        "exit from revolving balances, pair with autopay enrollment, and suppress "
        "high-APR cash offers until utilization declines."
    ),
    "Cash-Advance Reliant": (
        "Engage '{persona}' with liquidity alternatives. Offer {product}, "
        "emphasize transparent fees, and route customers away from repeated cash advances."
    ),
    "Dormant / Low Activity": (
        "Reactivate '{persona}' with low-friction nudges. Promote {product}, "
        "use first-purchase cashback, and keep onboarding steps minimal."
    ),
}
PERSONA_PLAYBOOK_FALLBACK = "Target the '{persona}' cohort with {product} using behaviour-aligned messaging."

# Business phrasing → persona; ordered, first hit wins, default Transactors.
PERSONA_PHRASE_RULES = [
    ("Cash-Advance Reliant", ["cash advance", "overdraft", "liquidity"]),
    ("Dormant / Low Activity", ["dormant", "inactive", "churn", "win back", "reactivat"]),
    ("The Revolvers", ["revolver", "debt", "balance transfer", "consolidat"]),
]
PERSONA_DEFAULT = "The Transactors"

# --- recommendation rules -------------------------------------------------
TIER_BUNDLES = [
    ("priority", "retain_and_expand", "Prioritize concierge retention and premium cross-sell.",
     ["premium_card_upgrade", "travel_benefits", "cashback_bundle"]),
    ("regular", "nurture_and_cross_sell", "Encourage recurring use and targeted cross-sell.",
     ["installment_offer", "auto_pay_enrollment", "category_rewards"]),
    ("dormant", "reactivation", "Use win-back nudges and low-friction offers.",
     ["fee_waiver_offer", "light_spend_campaign", "welcome_back_promo"]),
]
TIER_HIGH_QUANTILE = 0.67
TIER_LOW_QUANTILE = 0.33

# Behavioural tags: thresholds on cluster medians.
TAG_DEBT_CONSOLIDATION = "debt_consolidation_loan"      # util >= 0.6 and full <= 0.5
TAG_CREDIT_LINE = "cash_advance_alternative_credit_line"  # cash advance >= 0.25
TAG_PREMIUM = "premium_rewards_card"                     # one-off >= 0.35 and full >= 0.9
TAG_REACTIVATION = "reactivation_offer"                  # not dormant and freq median <= freq q33
UTIL_HIGH = 0.6
FULL_PAYMENT_LOW = 0.5
CASH_ADVANCE_HIGH = 0.25
ONEOFF_HIGH = 0.35
FULL_PAYMENT_HIGH = 0.9

# --- explanations -----------------------------------------------------------
FEATURE_LABELS = {
    "monthly_spend": "monthly spend",
    "avg_purchase_ticket": "average purchase ticket",
    "transaction_frequency_per_month": "transaction frequency",
    "cash_advance_ratio": "cash-advance ratio",
    "installment_purchase_share": "installment purchase share",
    "oneoff_purchase_share": "one-off purchase share",
    "credit_utilization_ratio": "credit utilization",
    "payment_to_minimum_ratio": "payment-to-minimum ratio",
    "full_payment_ratio": "full-payment ratio",
    "cash_advance_intensity": "cash-advance intensity",
    "credit_headroom": "credit headroom",
    "TENURE": "tenure",
}
MIN_SURROGATE_SAMPLES = 5
TOP_N_FEATURES = 5
BOUNDARY_RATIO_THRESHOLD = 0.85
SURROGATE_TREES = 50
SURROGATE_DEPTH = 8
SEED = 42
KMEANS_RESTARTS = 10

# --- query log / dashboard --------------------------------------------------
KNOWN_NODES = [
    "analytics",
    "eda",
    "feature_engineering",
    "segmentation",
    "recommendation",
    "evaluation",
    "visualization",
]

# Workflow steps per routed intent.
STEPS_SEGMENTATION = ["feature_engineering", "segmentation", "recommendation"]
STEPS_DESCRIPTIVE = ["eda"]

TOOL_EDA = "EDA_Tool"
TOOL_FEATURE_ENGINEERING = "Feature_Engineering"
TOOL_SEGMENTATION = "Segmentation_Engine"
TOOL_RECOMMENDATION = "Recommendation_Engine"
TOOL_CUSTOMER_LOOKUP = "Single_Customer_Lookup"
TOOL_SEGMENT_EXPLAINER = "Segment_Rule_Explainer"

# --- request text routing -------------------------------------------------
SEMANTIC_SIMILARITY_THRESHOLD = 0.18

INTENT_EXAMPLES = {
    "segmentation": [
        "segment customers into clusters",
        "group customers by spending behavior",
        "cluster customers into personas",
        "find customers suitable for investment products",
        "which customers are becoming inactive",
        "target customers for retention campaigns",
        "identify customers at risk of churn",
        "recommend products for high value customers",
        "cross sell premium offers to eligible customers",
        "find customers for loan upgrade campaigns",
        "marketing segmentation for customer targeting",
        "convert dormant customers with win back offers",
        "who should i market our high end credit card to",
        "market premium credit cards to the right customers",
        "which people are relying heavily on cash advances",
        "find customers with heavy cash advance usage",
        "target customers for high end credit card marketing",
    ],
    "descriptive": [
        "show descriptive statistics for the dataset",
        "summarize the dataset overview",
        "what are the summary stats",
        "explore missing values in the dataset",
        "show distributions of numeric columns",
        "correlation analysis of customer features",
        "profile the dataset with eda",
        "give me an overview of the data",
        "statistical summary of all columns",
    ],
    "explanation": [
        "explain why this customer is in this segment",
        "why was customer assigned to cluster",
        "explain the segment assignment for a customer",
        "how do you interpret this cluster membership",
        "explain customer lookup reasons",
        "clarify the risk explanation for this segment",
        "what does this segment mean for the customer",
        "why was customer placed in this segment",
        "is this customer suspicious",
        "look up why this customer was flagged",
    ],
}

SEGMENTATION_KEYWORDS = ["cluster", "clusters", "segment", "segmentation", "persona", "group", "grouping"]
BUSINESS_INTENT_KEYWORDS = [
    "recommend", "recommendation", "recommendations", "suitable", "eligible", "target", "targeted",
    "campaign", "campaigns", "retention", "inactive", "dormant", "churn", "upgrade", "priority",
    "cross", "upsell", "investment", "premium", "offer", "offers", "loan",
]
BUSINESS_INTENT_PHRASES = ["cross sell"]
DESCRIPTIVE_KEYWORDS = ["describe", "descriptive", "summary", "statistics", "statistical", "eda", "overview"]
RULE_ENGINE_TIER_NAMES = ["priority", "regular", "dormant"]
THRESHOLD_PHRASES = [
    "high value", "high spending", "high spender", "high spenders", "big spender", "big spenders",
    "low balance", "low spending", "heavy user", "heavy users", "top spenders", "big spend",
]
GENERIC_INTENT_TOKENS = [
    "a", "all", "an", "and", "are", "customer", "customers", "find", "for", "get", "give", "in",
    "is", "list", "me", "my", "of", "or", "show", "that", "the", "this", "to", "what", "which",
    "who", "with",
]

# Requested-filter domains and their trigger words (domain order matters).
FILTER_DOMAINS = [
    ("age", ["age", "aged", "old", "young", "years"]),
    ("city/location", ["city", "location", "chennai", "mumbai", "delhi", "bangalore", "country",
                       "state", "region", "zip", "area"]),
    ("gender", ["gender", "male", "female", "men", "women", "sex"]),
    ("account balance", ["account", "balance", "money", "funds"]),
    ("purchase frequency", ["purchase", "frequency", "buy", "often"]),
    ("credit limit", ["credit", "limit"]),
    ("tenure", ["tenure", "duration", "time", "months"]),
    ("payments", ["payment", "payments", "paid"]),
]
UNSUPPORTED_FILTER_REASON = "no matching column in current dataset"

# Second-opinion keyword intent.
EXPLANATION_KEYWORDS = ["explain", "why", "how", "meaning", "interpret", "understand", "clarify"]
EDA_KEYWORDS = ["explore", "analyze", "summary", "statistics", "describe", "overview", "profile"]

# Subjective terms, in a fixed order (the first contained term is reported).
SUBJECTIVE_TERMS = [
    "best customers",
    "best customer",
    "top customers",
    "top customer",
    "most valuable",
    "high-value",
    "high value",
    "profitable",
    "best",
]
SUBJECTIVE_ASSUMPTION = (
    "Assumed '{term}' refers to 'The Transactors' segment with high purchase "
    "volume and strong repayment behaviour (high full-payment tendency / low "
    "revolving risk), used as the operational definition of best customers."
)

CHART_WORDS = ["chart", "plot", "visual", "graph"]

AMBIGUITY_QUESTIONS = {
    "query_too_vague": (
        "Your query is too short to determine the analytical goal. "
        "Please specify what you want - for example: segment customers into groups, "
        "show descriptive statistics, or find customers suitable for a product offer."
    ),
    "unsupported_filters_only": (
        "This dataset does not include: {requested}. "
        "Your query relies on those filters and does not specify another analytical goal. "
        "What would you like to do instead - for example, segment all customers or "
        "show descriptive statistics?"
    ),
    "threshold_ambiguity": (
        "Your query uses a relative value term (such as high value or big spenders) "
        "without a numeric threshold or a known tier name. "
        "Please provide a numeric amount or choose a tier: priority, regular, or dormant."
    ),
}

# English stop words used by the TF-IDF routing vectors (Spark ML's English list
# is the default; see README for the deviation).

# Seeded synthetic profile generator ranges (column, low, high, integer?).
SYNTHETIC_RANGES = [
    ("BALANCE", 0, 5000, False),
    ("BALANCE_FREQUENCY", 0, 1, False),
    ("PURCHASES", 0, 3000, False),
    ("ONEOFF_PURCHASES", 0, 1500, False),
    ("INSTALLMENTS_PURCHASES", 0, 1500, False),
    ("CASH_ADVANCE", 0, 1000, False),
    ("PURCHASES_FREQUENCY", 0, 1, False),
    ("ONEOFF_PURCHASES_FREQUENCY", 0, 1, False),
    ("PURCHASES_INSTALLMENTS_FREQUENCY", 0, 1, False),
    ("CASH_ADVANCE_FREQUENCY", 0, 1, False),
    ("CASH_ADVANCE_TRX", 0, 9, True),
    ("PURCHASES_TRX", 1, 29, True),
    ("CREDIT_LIMIT", 1000, 15000, False),
    ("PAYMENTS", 0, 2000, False),
    ("MINIMUM_PAYMENTS", 0, 500, False),
    ("PRC_FULL_PAYMENT", 0, 1, False),
    ("TENURE", 6, 47, True),
]
