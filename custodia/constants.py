"""Fixed values of the governance model.

Everything below must equal the reference behaviour for results to match, so it is
stated as plain text: word lists, patterns, access tables, prompt and message texts.
"""

# --- fixed values: terms that raise a sensitivity flag, in report order -------------
SENSITIVE_TERMS = [
    "SSN",
    "AccountNumber",
    "Salary",
    "PatientName",
    "Confidential",
    "Password",
    "CreditCard",
    "BankAccount",
]

# --- fixed values: personal-data patterns in the order they are applied -------------
# (name, pattern, replacement tag)
PII_PATTERNS = [
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "[MASKED-SSN]"),
    ("ssn_no_dash", r"\b\d{9}\b", "[MASKED-SSN]"),
    ("credit_card", r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", "[MASKED-CC]"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[MASKED-EMAIL]"),
    ("phone", r"\b\d{3}-\d{3}-\d{4}\b", "[MASKED-PHONE]"),
    ("account_id", r"\b[A-Z]{2}\d{6}\b", "[MASKED-ID]"),
    ("salary", r"\$\d{1,3}(,\d{3})*(\.\d{2})?", "[MASKED-AMOUNT]"),
]
ALL_PII = [name for name, _, _ in PII_PATTERNS]
BASIC_PII = ["ssn", "ssn_no_dash", "credit_card", "account_id"]

# --- fixed values: role -> readable domains, in report order ------------------------
ROLE_ACCESS = {
    "admin": ["finance", "hr", "health", "public", "legal"],
    "analyst": ["finance", "hr", "public"],
    "manager": ["hr", "public"],
    "employee": ["public"],
    "guest": ["public"],
}
ROLES = list(ROLE_ACCESS)

# --- fixed values: (role, domain) -> patterns to mask; None = any other -------------
MASKING_RULES = [
    ("admin", None, BASIC_PII),
    ("analyst", "finance", ["ssn", "ssn_no_dash", "credit_card"]),
    ("analyst", "hr", ["ssn", "ssn_no_dash", "credit_card"]),
    ("manager", "hr", ["ssn", "ssn_no_dash", "credit_card", "salary"]),
    (None, None, ALL_PII),
]

# --- fixed values: department role -> general role ----------------------------------
DEPARTMENT_ROLES = {
    "accounting": {
        "manager": "analyst",
        "senior_accountant": "analyst",
        "accountant": "manager",
        "employee": "employee",
        "general": "guest",
    },
    "finance": {
        "manager": "analyst",
        "analyst": "analyst",
        "employee": "employee",
        "general": "guest",
    },
    "hr": {
        "manager": "manager",
        "hr_specialist": "analyst",
        "employee": "employee",
        "general": "guest",
    },
    "legal": {
        "manager": "admin",
        "legal_counsel": "analyst",
        "paralegal": "manager",
        "employee": "employee",
        "general": "guest",
    },
    "health": {
        "manager": "admin",
        "doctor": "analyst",
        "nurse": "manager",
        "employee": "employee",
        "general": "guest",
    },
}

ROLE_DESCRIPTIONS = {
    "admin": "full access to all domains",
    "analyst": "access to finance, hr, and public domains",
    "manager": "access to hr and public domains",
    "employee": "access to public domain only",
    "guest": "access to public domain only",
}
DEFAULT_ROLE_DESCRIPTION = "limited access"

# --- fixed values: compliance framework -> permitted domains ------------------------
FRAMEWORK_DOMAINS = {
    "hipaa": ["health", "public"],
    "gdpr": ["public"],
    "sox": ["finance", "public"],
    "general": ["public"],
}

# --- fixed values: topic words that route a question to a domain --------------------
ROUTING_TOPICS = {
    "finance": ["revenue", "sales", "earnings", "financial"],
    "hr": ["benefits", "policies", "handbook", "pto"],
    "health": ["hipaa", "medical", "healthcare"],
    "legal": ["contracts", "legal", "compliance", "regulations"],
}

# --- fixed values: agent names and the one used for unknown names -------------------
AGENTS = ["orchestrator", "retriever", "validator", "analyst", "summarizer"]
DEFAULT_AGENT = "retriever"
DEFAULT_PRIORITY = 999

# --- fixed values: limits and capacities --------------------------------------------
MAX_REQUESTS_PER_MINUTE = 60
MAX_REQUESTS_PER_USER_HOUR = 100
MAX_DENIALS_PER_HOUR = 10
LOG_RETENTION = 1000
AUDIT_RETENTION = 10000
CACHE_TTL_SECONDS = 3600
UPSERT_BATCH = 100
EMBEDDING_DIM = 1024
SEMANTIC_WEIGHT = 0.7
KEYWORD_WEIGHT = 0.3
VALIDATOR_VERSION = "1.0"
LATENCY_BUCKETS = [
    0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0,
]

# --- fixed values: names of the retrieval methods in results --------------------------
SEMANTIC_METHODS = {
    "cosine": "semantic-pinecone",
    "dot": "semantic-pinecone",
    "l2": "semantic-faiss",
}
KEYWORD_METHOD = "keyword-tfidf"
HYBRID_METHOD = "hybrid"

# --- fixed values: violation kinds and severities -----------------------------------
PII_DETECTED = "pii_detected"
TOXIC_CONTENT = "toxic_content"
RATE_LIMIT_EXCEEDED = "rate_limit_exceeded"
CRITICAL, HIGH, MEDIUM, LOW = "CRITICAL", "HIGH", "MEDIUM", "LOW"
TOXIC_DESCRIPTION = "Content flagged as toxic/vulgar by GPT-4o-mini"

# --- fixed values: entity kinds of the output gate ----------------------------------
ENTITY_KINDS = [
    "PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER",
    "CREDIT_CARD", "US_SSN", "US_DRIVER_LICENSE",
    "IBAN_CODE", "IP_ADDRESS", "MEDICAL_LICENSE",
]

# --- fixed values: texts shown for blocked messages ---------------------------------
BLOCKED_REASONS = {
    "TOXIC_CONTENT": "This message contains inappropriate content that violates our policy",
    "PII_DETECTED": "This message contains sensitive personal information that violates our policy",
    "RATE_LIMIT_EXCEEDED": "Too many requests detected. Please wait before trying again",
    "POLICY_VIOLATION": "This message violates our security policy",
}
BLOCKED_HEAD = "\U0001F6A8 This message violates our policy and has been blocked.\n\nReason: "
BLOCKED_TAIL = "\n\nI cannot assist with this request."

# --- fixed values: prompt texts -----------------------------------------------------
SYSTEM_PROMPT = """You are a secure AI assistant with access to verified, filtered enterprise documents.

Your responses must:
1. Only use information from the provided context
2. Never fabricate or guess information
3. Cite which documents you used
4. Respect data sensitivity (some information may be masked)
5. Be clear, concise, and professional"""
USER_PROMPT_HEAD = "Using ONLY the verified context below, answer the question.\n\nContext:\n"
USER_PROMPT_MIDDLE = "\n\nQuestion: "
USER_PROMPT_TAIL = (
    "\n\nProvide a clear answer based solely on the context. "
    "If the context doesn't contain enough information, say so."
)
REFUSAL_TEXT = (
    "I couldn't find any information I'm authorized to share with you based on your access level."
)

# --- default English stop words, a parameter: the list that Spark ML ships ---------
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
she her hers herself it its itself they them their theirs themselves what which who whom this
that these those am is are was were be been being have has had having do does did doing a an
the and but if or because as until while of at by for with about against between into through
during before after above below to from up down in out on off over under again further then
once here there when where why how all any both each few more most other some such no nor not
only own same so than too very s t can will just don should now i'll you'll he'll she'll we'll
they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've
you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't
wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's
there's what's when's where's who's why's would
""".split()
