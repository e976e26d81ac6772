"""Values fixed by the data model and the search rules.

Everything in this module is a fixed value: word lists, lookup tables, patterns, weights and limits that must
be exactly these for results to be right.  All of them are defaults; every operator takes them as parameters.
"""

# --- ingest ----------------------------------------------------------------------------------------------
# Texts that mean "no value".
SENTINELS = ("none", "nan", "null")
# Site texts that mean "no site".
SITE_BLANKS = ("none", "nan", "unknown", "unclassified")
# Rows above the header row of a tabular export.
TITLE_ROWS = 3

# --- mail columns ----------------------------------------------------------------------------------------
# Column names of the mail table.
CASES = "hvdc_cases"
INDEX_FIELDS = ("subject", "sendername", "senderemail", "recipientto", "plaintextbody", CASES, "company_name")
RESULT_COLUMNS = (
    "no", "deliverytime", "month", "subject", "sendername", "senderemail", "company_name", "recipientto",
    "site", "stage", CASES, "primary_case", "linkkey",
)
OPTIONAL_COLUMNS = ("case_numbers", "lpo_numbers", "rowkey")
SITE_COLUMNS = ("primary_site", "sites", "site")
EXACT_FIELDS = (
    CASES, "primary_case", "case_numbers", "lpo_numbers", "subject", "senderemail", "company_name", "linkkey",
    "rowkey", "plaintextbody",
)
REFINE_FIELDS = ("subject", "sendername", "senderemail", "deliverytime", "company_name", CASES, "month")
ENTITY_FIELDS = ("subject", "sendername", "senderemail", "company_name", "site", "stage", CASES)

# Code -> (name, aliases).
SITES = {
    "AGI": ("AL GHALLAN ISLAND", ("AGI", "AL GHALLAN ISLAND", "GHALLAN")),
    "DAS": ("DAS ISLAND", ("DAS", "DAS ISLAND")),
    "SHU": ("SHUWEIHAT", ("SHU", "SHUWEIHAT")),
    "MIR": ("MIRFA", ("MIR", "MIRFA")),
}

# --- chunks, vectors -------------------------------------------------------------------------------------
# Characters per chunk, characters shared by neighbours, body chunks per mail, vector width.
CHUNK_SIZE = 500
CHUNK_OVERLAP = 50
MAX_BODY_CHUNKS = 10
EMBED_BODY_CHARS = 500
EMBED_DIM = 384
CHUNK_OVERFETCH = 10

# --- full-text index -------------------------------------------------------------------------------------
# BM25 constants.
BM25_K1 = 1.2
BM25_B = 0.75
# English function words left out of the index.  A parameter: pass a longer list to `build_index` if wanted.
STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they",
    "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these", "those",
    "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did",
    "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by",
    "for", "with", "about", "against", "between", "into", "through", "during", "before", "after", "above",
    "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then",
    "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most",
    "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "can",
    "will", "just", "should", "now",
)

# --- query text ------------------------------------------------------------------------------------------
# Patterns and words for reading a query.
QUERY_TERM = r"[A-Za-z0-9가-힣][A-Za-z0-9가-힣/\-]{1,}"
QUERY_STOP_WORDS = ("or", "and", "the", "with", "for", "from")
HANGUL = "[가-힣]"
EDGE_PUNCTUATION = " ,.;:()[]{}"
CODE = r"\b([A-Za-z]{2,10})[-_/\s]*([0-9]{2,6})\b"
REF_PREFIX = "HVDC|CASE|PO|BL|BOE|MRR|FANR|INV"
LONG_NUMBER = r"\b\d{4,}\b"
JOINED_CODE = r"\b[A-Z0-9]{2,}(?:[-_/][A-Z0-9]+)+\b"
LETTER_DIGIT_CODE = r"\b[A-Z]{1,10}\d[A-Z0-9/-]{3,}\b"
PREFIXED_CODE = rf"\b(?:{REF_PREFIX})[-:/\s]?[A-Z0-9][A-Z0-9\-/]{{4,}}\b"
MAX_IDENTIFIER_TERMS = 16

# --- masking ---------------------------------------------------------------------------------------------
# Fixed values: (pattern, replacement), applied in this order, case-insensitive.
MASKS = (
    (r"\b[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}\b", "[email]"),
    (r"\+?\d[\d\s().\-]{7,}\d", "[phone/ref]"),
    (r"\b[A-Z]{1,5}[-:/ ]?\d{5,}[A-Z0-9\-/]*\b", "[ref]"),
    (r"\b\d{8,}\b", "[ref]"),
)

# --- entities --------------------------------------------------------------------------------------------
# Tag -> pattern, case-insensitive; tags whose values are masked; order in the chip text.
ENTITY_PATTERNS = {
    "Site": r"\b(?:AGI|DAS|MIR|SHU|MOSB)\b",
    "Vendor": r"\b(?:DSV|Mammoet|ADNOC|ALS|SCT|Samsung C&T|HMM|COSCO)\b",
    "Doc": r"\b(?:BL|B/L|BOE|DO|MRR|CIPL|FANR|Invoice|Packing List|Purchase Order)\b",
    "Issue": r"\b(?:DEM|DET|demurrage|detention|claim|delay|delayed|hold|customs clearance"
             r"|통관|지연|클레임|디머리지|디텐션|승인|보류)\b",
    "Ref": rf"\b(?:{REF_PREFIX})[-:/\s]?[A-Z0-9][A-Z0-9\-/]{{4,}}\b|\b\d{{8,}}\b",
}
MASKED_TAGS = ("Ref", "BL", "PO", "Case")
CHIP_ORDER = ("Vendor", "Issue", "Site", "Doc", "Ref", "BL", "PO", "Case")
MAX_ENTITY_VALUES = 6
MAX_CHIP_VALUES = 3

# --- issue clusters, decision words ----------------------------------------------------------------------
# Label -> keywords, the first label that hits wins.
ISSUE_KEYWORDS = {
    "DEM/DET": ("demurrage", "detention", "dem/det", " dem ", " det "),
    "통관": ("customs", "clearance", "통관", "boe", "duty", "tariff"),
    "선적지연": ("delay", "delayed", "postpone", "reschedule", "선적지연", "지연"),
    "MOSB": ("mosb", "mother ship", "offshore"),
    "MRR": ("mrr", "material receipt", "receiving report"),
}
ISSUE_OTHER = "기타"
DECISION_WORDS = (
    "approve", "approved", "approval", "confirm", "confirmed", "reject", "rejected", "hold", "pending", "claim",
    "decision", "승인", "확정", "보류", "클레임",
)
KEY_DECISION_QUERY = "승인 결정 confirm approve reject decision"

# --- glossary --------------------------------------------------------------------------------------------
# Key -> (variants, English terms).
GLOSSARY = {
    "디머리지": (("디머리지", "DEM", "demurrage"), ("DEM", "demurrage", "detention")),
    "디텐션": (("디텐션", "DET", "detention"), ("DET", "detention", "demurrage")),
    "dem": (("DEM", "디머리지", "demurrage"), ("DEM", "demurrage", "detention")),
    "det": (("DET", "디텐션", "detention"), ("DET", "detention", "demurrage")),
    "클레임": (("클레임", "claim", "분쟁"), ("claim", "dispute", "supporting invoice")),
    "기성": (("기성", "기성금", "기성청구", "기성고"), ("progress payment", "interim payment", "IPC")),
    "통관": (("통관", "수입통관", "세관"), ("customs clearance", "customs")),
    "선적": (("선적", "적재", "본선적재"), ("shipment", "shipping", "loading")),
    "하역": (("하역", "양하", "양륙"), ("discharge", "unloading", "offloading")),
    "지연": (("지연", "딜레이", "지체"), ("delay", "delayed", "demurrage", "detention")),
    "정산": (("정산", "정산서", "비용정산"), ("settlement", "reconciliation")),
    "검사": (("검사", "검수", "수입검사"), ("inspection", "MRR", "material receiving report")),
    "송장": (("송장", "인보이스", "청구서"), ("invoice", "billing")),
    "납품": (("납품", "납기", "납품서"), ("delivery", "delivery note", "DN")),
    "발주": (("발주", "구매발주", "발주서"), ("purchase order", "PO")),
    "운송": (("운송", "수송", "내륙운송"), ("transport", "transportation", "trucking")),
    "보관": (("보관", "창고보관", "장치"), ("storage", "warehouse", "warehousing")),
    "통보": (("통보", "통지", "공지"), ("notice", "notification")),
    "승인": (("승인", "결재", "허가"), ("approval", "approved")),
    "계약": (("계약", "계약서", "약정"), ("contract", "agreement")),
    "견적": (("견적", "견적서", "가격"), ("quotation", "quote")),
    "포장": (("포장", "패킹", "포장명세"), ("packing", "packing list")),
    "통선": (("통선", "부선", "바지"), ("barge", "feeder vessel")),
    "중량물": (("중량물", "초중량", "대형화물"), ("heavy lift", "heavy cargo", "oversized")),
    "면장": (("면장", "수입면장", "통관면장"), ("customs declaration", "bill of entry", "BOE")),
    "fanr": (("FANR", "fanr"), ("FANR", "approval", "notice")),
    "mrr": (("MRR", "mrr", "검수"), ("MRR", "material receiving report", "inspection")),
}
MAX_EXPANSIONS = 8
# Word -> synonyms used by the query rewrite; English terms per glossary hit; terms kept.
SYNONYMS = {
    "dem": ("DEM", "demurrage", "detention"),
    "det": ("DET", "detention", "demurrage"),
    "claim": ("claim", "dispute", "supporting invoice"),
    "delay": ("delay", "delayed", "hold"),
    "boe": ("BOE", "bill of entry", "customs declaration"),
    "mrr": ("MRR", "material receiving report", "inspection"),
}
REWRITE_TERMS_PER_HIT = 3
REWRITE_TERMS = 5

# --- ranking ---------------------------------------------------------------------------------------------
# Weights, labels and limits of the fused score.
FIELD_WEIGHTS = {
    CASES: 0.35, "primary_case": 0.35, "case_numbers": 0.35, "lpo_numbers": 0.30, "subject": 0.25,
    "senderemail": 0.15, "company_name": 0.15, "linkkey": 0.10, "rowkey": 0.25,
}
FIELD_LABELS = {
    "no": "no", CASES: "case", "primary_case": "case", "case_numbers": "case", "lpo_numbers": "lpo",
    "subject": "subject", "senderemail": "sender", "company_name": "company", "linkkey": "pdf",
    "rowkey": "rowkey",
}
STRONG_FIELDS = tuple(f for f in EXACT_FIELDS if f != "plaintextbody")
FUSION_WEIGHTS = {
    "bm25_rrf": 10.0, "vector_rrf": 8.0, "exact_rrf": 8.0, "exact_score": 0.50, "field_match": 0.12,
    "entity_match": 0.12, "recency_score": 0.05, "decision_signal": 0.05,
}
RRF_K = 60
MISSING_AGE_DAYS = 9999
MAX_REASON_TERMS = 6
MAX_REASONS = 4
MAX_FIELD_TERMS = 8
MAX_ENTITY_SCORE_VALUES = 4
MAX_ENTITY_SCORE_TERMS = 6
RESULT_LIMIT = 200

# --- filter specifications -------------------------------------------------------------------------------
# Fields, operators and limits of a filter specification.
FILTER_FIELDS = (
    "deliverytime", "sendername", "senderemail", "company_name", "site", "stage", "month", CASES, "subject",
)
FILTER_OPS = ("eq", "neq", "ilike", "not_ilike", "in", "gte", "lte", "gt", "lt", "between")
MAX_FILTERS = 8
MAX_FILTER_VALUES = 20
MAX_FILTER_CHARS = 200

# --- attachments -----------------------------------------------------------------------------------------
# Patterns of file titles, keys and file ids, and the two link formats.
TITLE_KEY = r"^([0-9a-f]{12})(?:_|\.pdf$)"
LINK_KEY = r"\b[0-9a-fA-F]{12}\b"
FILE_ID = r"(?:drive\.google\.com/file/d/|[?&]id=)([A-Za-z0-9_-]{20,})"
VIEW_URL = "https://drive.google.com/file/d/{id}/view?usp=sharing"
DOWNLOAD_URL = "https://drive.google.com/uc?export=download&id={id}"
LOOSE_FILE_TITLE = "Google Drive PDF"

# --- analytics -------------------------------------------------------------------------------------------
# Report sizes.
UNCLASSIFIED = "Unclassified"
UNKNOWN_TARGET = "Unknown"
TOP_SENDERS = 20
TOP_SHARES = 12
MIN_EDGE_WEIGHT = 5
MAX_EDGES = 150
LISTED_EDGES = 30
KEY_DECISIONS = 10
SENDER_HISTORY = 20
SIMILAR_DOCUMENTS = 5
FILTERED_RESULTS = 50
EVAL_TOP_K = 10
ZERO_RESULT_CATEGORY = "zero_result"
