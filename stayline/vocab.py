"""Vocabularies and constants. They must equal the definitions that results are compared with."""

CHURN_WORDS = (
    "churned", "churn", "canceled", "cancelled", "cancellation", "yes", "inactive", "closed", "true", "terminated",
    "lost", "customer-offboarding",
)
ACTIVE_WORDS = (
    "active", "no", "current", "open", "false", "subscribed", "trialing", "trialling", "past_due", "incomplete",
    "paused", "customer", "opportunity", "lead", "subscriber", "solved",
)
HIERARCHY_RANK = {
    "cancellation_intent": 1, "renewal_or_contract_concern": 2, "product_bug_or_outage": 3,
    "poor_support_experience": 3, "billing_complaint": 4, "feature_missing": 4, "usage_drop_related": 4,
    "competitor_mention": 5,
}
UNRANKED = 99
HIERARCHY_WEIGHT = {
    "cancellation_intent": 1.0, "renewal_or_contract_concern": 0.85, "product_bug_or_outage": 0.7,
    "poor_support_experience": 0.7, "billing_complaint": 0.55, "feature_missing": 0.55,
    "usage_drop_related": 0.55, "competitor_mention": 0.45, "positive_feedback": 0.0, "other": 0.3,
}
STRENGTH_SCORE = {"weak": 0.33, "moderate": 0.66, "strong": 1.0}
STRENGTH_ORDER = {"none": 0, "weak": 1, "moderate": 2, "strong": 3}
PERSISTENT_FLAGS = ("cancellation_intent", "renewal_or_contract_concern")
DECAY, DECAY_PERSISTENT = 0.015, 0.004
LIFT_POINTS = ((0.0, 0.0), (1.0, 0.2), (1.5, 0.4), (3.0, 0.7), (6.0, 1.0))
LEVELS = ("critical", "high", "medium", "low")
MODEL_CONFIDENCE = {"READY": 1.0, "WARNING": 0.7, "FALLBACK": 0.45, "INSUFFICIENT_DATA": 0.0, "FAILED": 0.0}
CHURN_LANGUAGE = (
    "cancel", "cancelling", "terminate", "switch", "leave", "refund", "not renewing", "stop subscription",
)
URGENT_WORDS = ("urgent", "asap", "emergency", "immediate")
CLARITY_WORDS = ("cancel", "cancelling", "terminate", "switch", "leave", "refund")
NEGATIONS = ("not", "no", "never", "don't", "dont", "won't", "wont", "without")
KEY_PHRASES = (
    "cancel", "renew", "refund", "billing", "downgrade", "upgrade", "outage", "crash", "bug", "slow", "login",
    "password", "invoice", "overcharged", "competitor", "switch", "seat", "sso", "export", "integration",
)
#: flag type, severity, strength, sentiment, keywords; in order, the first rule of a flag type that hits wins.
FLAG_RULES = (
    ("cancellation_intent", "high", "strong", -0.6, (
        "i want to cancel", "please cancel", "cancel my plan", "cancel my subscription", "cancel my account",
        "terminate my contract", "i need to terminate", "not renewing", "stop my subscription", "i am leaving",
        "i am cancelling")),
    ("cancellation_intent", "medium", "moderate", -0.4, (
        "thinking about cancelling", "thinking of cancelling", "considering cancelling", "may cancel", "undecided")),
    ("cancellation_intent", "low", "weak", -0.3, ("maybe cancel", "about to cancel", "not sure i am getting value")),
    ("renewal_or_contract_concern", "medium", "moderate", 0.0, (
        "renew my", "renewal", "extend my contract", "extend it", "when does my plan renew")),
    ("product_bug_or_outage", "high", "strong", -0.5, (
        "system is down", "outage", "keeps crashing", "crashing", "broken again", "sync failed")),
    ("product_bug_or_outage", "high", "strong", -0.5, (
        "unusable", "still not fixed", "not fixed", "still down", "still happening", "has been down", "down for",
        "completely down", "still broken", "nothing works")),
    ("product_bug_or_outage", "medium", "moderate", -0.4, ("error", "crash", "bug", "broken", "failed", "sync failed")),
    ("poor_support_experience", "high", "strong", -0.7, (
        "urgent", "asap", "emergency", "immediate help", "unacceptable")),
    ("poor_support_experience", "medium", "moderate", -0.5, ("frustrated", "slow and unhelpful", "very frustrating")),
    ("billing_complaint", "medium", "moderate", -0.4, (
        "wrong amount", "overcharged", "refund", "billing changes", "not happy with the billing", "billing is wrong",
        "charged twice")),
    ("feature_missing", "medium", "moderate", -0.3, (
        "feature i paid for is missing", "missing feature", "feature is missing")),
    ("competitor_mention", "medium", "moderate", -0.3, (
        "other vendors", "other providers", "evaluating alternatives", "considering alternatives",
        "looking at alternatives", "alternative vendor")),
    ("competitor_mention", "low", "weak", -0.2, ("competitor", "switch to", "switching to")),
    ("positive_feedback", "low", "weak", 0.6, (
        "love the product", "great job", "amazing support", "fantastic", "highly recommend", "very happy",
        "keep it up", "great experience", "solved my issue", "resolved my issue", "very helpful",
        "excellent support")),
)
LANGUAGES = ("en", "es", "de", "fr")
STOPWORDS = {
    "en": (
        "the", "and", "to", "of", "a", "is", "it", "you", "we", "i", "this", "that", "my", "can", "please", "help", "how",
        "do", "not", "for", "on"),
    "es": (
        "el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "por", "para", "con", "no", "mi", "es", "como",
        "pero", "muy", "estoy", "ayuda"),
    "de": (
        "der", "die", "das", "und", "ich", "nicht", "ist", "zu", "den", "mit", "ein", "eine", "für", "auf", "sie", "wir",
        "bitte", "kann", "wie", "mein"),
    "fr": (
        "le", "la", "les", "de", "et", "un", "une", "je", "ne", "pas", "que", "pour", "avec", "est", "dans", "sur", "mon",
        "vous", "nous", "aide"),
}
ACCENTS = {
    "es": ("ñ", "¿", "¡", "á", "é", "í", "ó", "ú"),
    "de": ("ß", "ä", "ö", "ü"),
    "fr": ("ç", "è", "ê", "à", "ù", "œ", "â"),
}
LEAKY_NAMES = "churn|cancel|attrit|terminat|exit|closed|left|reason|outcome|label|target"
CORE_KEYS = ("plan_tier", "contract_length_months", "usage_frequency")

# What explanations are searched for.
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november",
    "december",
)
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16,
    "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60,
    "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100,
}
CANCELLATION_PHRASES = ("cancel", "terminat", "end the contract", "leave us")
PROBABILITY_PHRASES = ("% chance", "chance of", "probability of churn", "likely to churn", "probability that")
CALM_PHRASES = ("will remain active", "remain active", "stays active", "stay active", "no risk")
FLAG_PHRASES = {
    "competitor_mention": (
        "competitor", "competition", "competing", "switch to", "switching to", "switching provider",
        "alternative provider", "another provider", "another vendor", "other vendor"),
    "usage_drop_related": (
        "usage decline", "usage drop", "declining usage", "declining activity", "reduced usage", "reduced activity",
        "usage has declined", "less active"),
    "renewal_or_contract_concern": (
        "renewal concern", "contract concern", "renewal", "contract renewal", "contract expiry", "contract expiring"),
    "product_bug_or_outage": (
        "outage", "product bug", "product issue", "product problem", "downtime", "system failure"),
    "poor_support_experience": (
        "poor support", "unresolved complaint", "support experience", "bad support", "support issues"),
    "billing_complaint": (
        "billing complaint", "billing issue", "invoice", "overcharged", "billing problem", "billing", "pricing", "price",
        "expensive", "overpriced", "too costly", "cost concern"),
    "feature_missing": ("missing feature", "feature request", "requested functionality", "feature gap"),
}
DISSATISFACTION_PHRASES = ("frustrat", "dissatisf", "unhappy", "disappointed", "annoyed", "upset")
FACT_PHRASES = (
    "has been with us", "has been a customer", "has been our customer", "years of experience", "long-time customer",
    "long time customer", "contacted support", "contacted us", "reached out to support", "changed their plan",
    "changed plans", "changed their subscription", "signed up", "onboarded", "acquired", "acquisition", "merger",
    "merged", "bankrupt", "laid off", "headquarters", "subsidiary",
)
ACTION_PHRASES = (
    "offer", "discount", "refund", "upgrade", "downgrade", "escalate", "compensate", "compensation", "waive",
    "retention", "incentive", "contact sales", "reach out", "schedule", "provide", "credit", "reimburse", "apologize",
    "expedite", "upsell", "cross-sell", "migrate", "contact", "call", "follow up", "follow-up", "meeting", "reach the",
)
