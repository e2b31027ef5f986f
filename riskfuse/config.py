"""Fixed values that must equal the reference application's for identical results.

Everything in this module is data (constants, lists, lookup tables); the logic that
uses it lives in ``riskfuse.functions`` and ``riskfuse.operators``.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (service policy) -- weights, thresholds, penalties, names
# ---------------------------------------------------------------------------

BASE_WEIGHTS = {"numerical": 0.45, "nlp": 0.35, "voice": 0.20}

# (nlp_used, voice_used) -> (numerical, nlp, voice); numerical is always used.
SERVICE_WEIGHTS = {
    (True, True): (0.45, 0.35, 0.20),
    (True, False): (0.5625, 0.4375, 0.0),
    (False, True): (0.6923, 0.0, 0.3077),
    (False, False): (1.0, 0.0, 0.0),
}

PENALTY_FULL = 0.00
PENALTY_PARTIAL_NO_VOICE = 0.15
PENALTY_PARTIAL_NO_NLP = 0.20
PENALTY_FALLBACK = 0.40
PENALTY_PER_FAILED = 0.05
PENALTY_CAP = 0.60

APPROVE_MAX = 0.30
REVIEW_MAX = 0.70

RISK_LOW_MAX = 0.25
RISK_MEDIUM_MAX = 0.50
RISK_HIGH_MAX = 0.75

FALLBACK_FORCE_REVIEW = 0.25
FALLBACK_FORCE_BLOCK = 0.60
PARTIAL_LOW_CONFIDENCE = 0.70
PARTIAL_FORCE_REVIEW_SCORE = 0.40

# channel -> (nlp default, voice default); unknown channel -> (True, False)
CHANNEL_DEFAULTS = {
    "online": (True, False),
    "phone": (True, True),
    "in_person": (True, True),
    "atm": (False, False),
}
CHANNELS = ("online", "phone", "in_person", "atm")

MODEL_VERSION = "2.0.0"
TOP_FACTORS_COUNT = 5
CONTRIBUTION_BASELINE = 0.02

# combination description + nominal confidence by (nlp, voice) availability
COMBO_INFO = {
    (True, True): ("Full tri-modal ensemble: Numerical + NLP + Voice", 1.00),
    (True, False): ("Partial ensemble: Numerical + NLP (voice unavailable)", 0.85),
    (False, True): ("Partial ensemble: Numerical + Voice (NLP unavailable)", 0.80),
    (False, False): ("Fallback mode: Numerical only", 0.60),
}

SIGNAL_DISPLAY_NAMES = {
    "amount_anomaly": "Transaction Amount Anomaly",
    "velocity_risk": "Transaction Velocity Risk",
    "pattern_deviation": "Behavioral Pattern Deviation",
    "geo_risk": "Geographic Risk",
    "semantic_risk": "Semantic Risk in Description",
    "typosquatting_risk": "Merchant Typosquatting Risk",
    "entity_inconsistency": "Entity Inconsistency",
    "deepfake_probability": "Deepfake Voice Detection",
    "voice_stress_indicator": "Voice Stress Level",
    "speaker_consistency": "Speaker Verification Score",
}

# signal order per modality (insertion order decides ties in the top factors)
NUMERICAL_SIGNALS = ("amount_anomaly", "velocity_risk", "pattern_deviation", "geo_risk")
NLP_SIGNALS = ("semantic_risk", "typosquatting_risk", "entity_inconsistency")
VOICE_SIGNALS = ("deepfake_probability", "voice_stress_indicator", "speaker_consistency")

# ---------------------------------------------------------------------------
# FIXED VALUES (service rule scorers)
# ---------------------------------------------------------------------------

SERVICE_RISK_CATEGORIES = ("gambling", "crypto", "wire_transfer", "cash_advance")
SERVICE_RISK_COUNTRIES = ("NG", "RU", "CN", "BR", "IN")
SERVICE_NUMERICAL_WEIGHTS = (0.35, 0.25, 0.25, 0.15)  # amount, velocity, pattern, geo
SERVICE_TYPO_PATTERNS = ("amaz0n", "paypa1", "app1e", "g00gle", "micr0soft")
SERVICE_RISK_WORDS = ("urgent", "wire", "bitcoin", "crypto", "prize", "winner", "lottery")
SERVICE_TEXT_WEIGHTS = (0.35, 0.45, 0.20)  # semantic, typosquatting, entity
SERVICE_TYPO_BASE = 0.1
SERVICE_SEMANTIC_BASE = 0.2

# The reference draws these from uniform bands; here they are parameters whose
# defaults are the band midpoints, so results are reproducible.
SERVICE_DEFAULT_PARAMS = {
    "velocity_risk": 0.30,          # uniform(0.10, 0.50)
    "pattern_risky": 0.75,          # uniform(0.60, 0.90)
    "pattern_normal": 0.25,         # uniform(0.10, 0.40)
    "geo_risky": 0.65,              # uniform(0.50, 0.80)
    "geo_normal": 0.20,             # uniform(0.10, 0.30)
    "typo_hit": 0.85,               # uniform(0.75, 0.95)
    "typo_digit": 0.60,             # uniform(0.50, 0.70)
    "semantic_hit": 0.65,           # uniform(0.50, 0.80)
    "entity": 0.25,                 # uniform(0.10, 0.40)
}

# ---------------------------------------------------------------------------
# FIXED VALUES (dashboard policy)
# ---------------------------------------------------------------------------

DASH_RISK_COUNTRIES = ("NG", "RU", "CN", "BR", "IN", "PK", "KE", "GH")
DASH_RISK_CATEGORIES = ("gambling", "crypto", "wire_transfer", "cash_advance", "forex")
DASH_TYPO_PATTERNS = ("amaz[o0]n", "paypa[l1]", "app[l1]e", "g[o0]{2}gle", "micr[o0]soft", "[a4]mazon")
DASH_RISK_WORDS = ("urgent", "wire", "bitcoin", "crypto", "prize", "winner", "lottery", "transfer", "offshore")
DASH_GEO = (0.82, 0.11)
DASH_PATTERN = (0.88, 0.17)
DASH_VELOCITY = 0.24
DASH_COMPOUND = 0.10
DASH_NUMERICAL_CAP = 0.98
DASH_NUMERICAL_WEIGHTS = (0.35, 0.20, 0.25, 0.20)  # amount, velocity, pattern, geo
DASH_TYPO = (0.08, 0.88, 0.52)  # base, pattern hit, contains o/0
DASH_SEMANTIC = (0.15, 0.74)
DASH_ENTITY = 0.12
DASH_STREAM_CONFIDENCE = {"numerical": 0.91, "nlp": 0.85, "voice": 0.92}
DASH_BLOCK_MIN = 0.71
DASH_REVIEW_ABOVE = 0.30
DASH_FALLBACK_BLOCK_MIN = 0.60
DASH_FALLBACK_REVIEW_ABOVE = 0.25

# ---------------------------------------------------------------------------
# FIXED VALUES (text stream)
# ---------------------------------------------------------------------------

EMAIL_PATTERN = r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE_PATTERN = r"\b(?:\+?\d{1,3}[\s.-]?)?(?:\(?\d{3}\)?[\s.-]?)\d{3}[\s.-]?\d{4}\b"
CARD_PATTERN = r"\b(?:\d[ -]*?){13,19}\b"
MAX_CHARS = 6000
NUMERICAL_MISSING = "numerical score is missing (required)"
NO_TEXT = "[NO_TEXT]"

FRAUD_CUES = (
    "urgent", "immediately", "asap", "right away", "wire", "transfer now", "send now",
    "do not delay", "chargeback", "dispute", "fraudulent", "unauthorized", "scam",
    "phishing", "account compromised", "gift card", "crypto", "bitcoin", "refund",
    "overpayment", "invoice",
)
HEURISTIC_VERSION = "heuristic_v1"

NEGATIVE_LABEL_NAMES = ("0", "label_0", "non_fraud", "non-fraud", "legit", "negative")
POSITIVE_LABEL_NAMES = ("1", "label_1", "fraud", "positive")

LABEL_ALIASES = ("isFraud", "is_fraud", "fraud", "label", "target")

# ---------------------------------------------------------------------------
# FIXED VALUES (offline data work)
# ---------------------------------------------------------------------------

SPLIT_RATIOS = (0.70, 0.15, 0.15)
RANDOM_STATE = 42
INTERIM_COLUMNS = ("transaction_id", "text", "label", "amount", "transaction_type", "dataset_source")
TRANSFORMER_THRESHOLD = 0.0039
VOICE_THRESHOLD = 0.5

# Python's str whitespace set (what ``\s`` and ``str.strip()`` use), as a regex class
# that Java and RE2 read the same way.
WHITESPACE_CLASS = (r"[\t\n\x0B\x0C\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
# Unicode word character (letters, numbers, underscore).
WORD_CLASS = r"[\p{L}\p{N}_]"

TEXT_SOURCES = ("merchant", "narrative", "invoice", "ticket")
CHOOSE_ORDER = ("invoice", "merchant", "narrative", "ticket")
SOURCE_HEADERS = {"merchant": "[MERCHANT]", "narrative": "[NARRATIVE]", "invoice": "[INVOICE]", "ticket": "[TICKET]"}

# brand names watched by the edit-distance typosquatting check
WATCHED_BRANDS = ("amazon", "paypal", "apple", "google", "microsoft")
