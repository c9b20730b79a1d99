"""Word lists, enums, weights and patterns that results depend on."""

# -- enums -------------------------------------------------------------------
NODE_TYPES = ["person", "location", "time_anchor", "clue_object", "event", "evidence_sentence"]
EDGE_TYPES = [
    "located_at", "appears_at", "belongs_to", "mentions", "temporal_sequence", "supports",
    "contradicts", "related_to", "motive", "means", "opportunity", "witnessed_by",
]
DROP_REASONS = ["literary_description", "filler_dialogue", "scene_setting", "digression", "other"]
LETTERS = "ABCD"

# -- story time --------------------------------------------------------------
PERIODS = ["morning", "noon", "afternoon", "evening", "night"]
PERIOD_RANK = {"unknown": 0, "morning": 1, "noon": 2, "afternoon": 3, "evening": 4, "night": 5}
PERIOD_HOUR = {"unknown": 12, "morning": 8, "noon": 12, "afternoon": 15, "evening": 19, "night": 22}
PERIOD_DURATION = {"unknown": 8, "morning": 4, "noon": 2, "afternoon": 4, "evening": 3, "night": 2}
DAY_PATTERN = r"(?:day|d)\s*(\d+)"

# -- tokens and names --------------------------------------------------------
TOKEN_PATTERN = "[a-z0-9一-鿿]+"
STOP_WORDS = [
    "the", "a", "an", "of", "to", "in", "on", "at", "was", "were", "is", "are", "and", "or",
    "did", "do", "what", "who", "how",
]
PRONOUNS = ["he", "him", "his", "she", "her", "i", "me", "my", "we", "us", "our", "they", "them", "their"]
GENERIC_NAME = r"^the (man|woman|girl|boy|killer|murderer|victim|narrator|doctor|servant|patient|body)$"
GENERIC_PERSONS = [
    "the killer", "the murderer", "the victim", "the woman", "another man", "young man",
    "husband", "inspector", "the girl", "the boy",
]
TITLE_TOKENS = [
    "mr", "mrs", "miss", "ms", "m", "mme", "madame", "lady", "lord", "sir", "dr", "doctor",
    "prof", "professor", "captain", "inspector", "detective",
]
MALE_TITLES = ["mr", "lord", "sir"]
FEMALE_TITLES = ["mrs", "miss", "ms", "mme", "madame", "lady"]
NAME_RATIO = 0.65

# -- question rules, in order of precedence ----------------------------------
NEGATIVE_WORDS = ["not", "incorrect", "false", "except", "never", "least likely", "ruled out"]
KILLER_WORDS = ["who killed", "killer", "murderer", "perpetrator", "mastermind", "instigator"]
IDENTITY_WORDS = ["identity", "real identity", "impersonat", "disguise", "who is", "who was", "whose body"]
WHO_WORDS = ["who", "killer", "murderer", "murder", "thief", "stole", "stolen", "robber", "burglar"]
QUESTION_RULES = [
    ("negative_check", NEGATIVE_WORDS),
    ("killer", KILLER_WORDS),
    ("identity", IDENTITY_WORDS),
    ("motive_reason", ["why", "reason", "motive", "purpose", "cause of", "caused"]),
    ("quantity_symbol", ["how many", "number of", "symbol", r"letters?\s+[a-z0-9]"]),
    ("location", ["where", "location", "room", "place"]),
    ("time_order", ["when", "before", "after", "time", "order"]),
    ("method", ["how did", "method", "means", "weapon", "through"]),
]
QUESTION_RULES_SHORT = [
    ("negative", [*NEGATIVE_WORDS, "couldn't possibly"]),
    ("killer", KILLER_WORDS),
    ("identity", IDENTITY_WORDS),
    ("reason", ["why", "reason", "motive", "purpose", "cause"]),
]
CONFESSION_WORDS = [
    "confess", "confessed", "confession", "protect", "said she was the killer",
    "said he was the killer", "guilty", "in fact", "actually", "wasn't her", "not her",
]
SUSPICIOUS_TEXT = (
    r"(?i)<br>|\bpieces? of\b|\b200 acres\b|\bMists? Drawn\b|\bKagoshima\b|\bXi Yan\b"
)

# -- answer-letter grammars: (pattern, which match wins) ---------------------
LETTER_LAST = [
    r"(?i)\bselected_letter\b\s*[:=]\s*[\"']?([A-D])",
    r"(?i)\b(?:final\s+)?answer\s*[:=\-]?\s*\(?([A-D])\)?",
    r"(?i)\bcorrect\s+(?:answer|option)\s+(?:is\s+)?\(?([A-D])\)?",
    r"^\s*\(?([A-D])\)?(?:[.\):\s]|$)",
]
LETTER_MARKED = [
    r"Answer\s*[:：]\s*\(?([A-D])\)?",
    r"Letter\s*[:：]\s*\(?([A-D])\)?",
    r"(?:^|\s)\(?([A-D])\)?\s*[.:、]\s*(?:[A-Za-z])",
    r"(?:^|\s)([A-D])\s*[.:、]",
]
LETTER_PROSE = [
    r"(?i)most\s+fitting\s+answer\s+is\s*\(?([A-D])\)?",
    r"(?i)closest\s+match[\s\S]{0,100}?\b(?:is|be)\s*\(?([A-D])\)?",
    r"(?i)killer[\s\S]{0,80}?\bis\s*\(?([A-D])\)?",
    r"(?i)(?:incorrect\s+statement|option|choice)\s*(?:is\s*:|is|:)\s*\n?\s*([A-D])\s*[.\):]",
    r"(?i)\boption\s+([A-D])\b",
    r"(?m)^\s*([A-D])\s*[.)]\s+",
]
LETTER_BILINGUAL = [
    r"(?i)selected_letter[\"\s:=-]+([ABCD])\b",
    "(?i)(?:answer|option|答案|选项)\\s*(?:is|为|:|：)?\\s*([ABCD])\\b",
    "(?i)^\\s*([ABCD])(?:\\b|[.、:：])",
]
ANSWER_NUMBER = r"(?i)\bANSWER\s*[:=]?\s*(\d+)"
ANSWER_TAIL_LETTER = r"(?m)\b([A-D])\b\s*[).:]?\s*$"
VERDICT_CONTRADICT = ["contradict", "false", "refute", "incorrect"]
VERDICT_SUPPORT = ["support", "true", "entail", "correct"]
OPTION_ENTITY = r"(?i)^(?:letter|option|candidate|choice|answer)\s*[-_: ]*[a-d0-9]*$"

# -- relation classes and weights --------------------------------------------
LOW_VALUE_RELATIONS = ["related_to", "mentions", "located_at", "appears_at"]
HIGH_VALUE_RELATIONS = [
    "supports", "contradicts", "motive", "means", "opportunity", "witnessed_by",
    "belongs_to", "temporal_sequence",
]
SUSPECT_EDGE_TYPES = ["motive", "means", "opportunity", "contradicts", "supports"]
INFORMATIVE_TYPES = ["clue_object", "location", "time_anchor", "event"]
TYPE_BOOST = {
    "clue_object": 1.6, "location": 1.3, "time_anchor": 1.3,
    "evidence_sentence": 1.2, "event": 1.1, "person": 1.0,
}
BM25_K1, BM25_B = 1.5, 0.75
RANK_ALPHA, RANK_ITERATIONS = 0.78, 16
WILSON_Z = 1.959963984540054
TOKEN_PRICES = {"prompt": 2.1e-6, "cached": 0.21e-6, "completion": 8.4e-6}
CHUNK_SIZE, CHUNK_OVERLAP = 1500, 100


# Named routes of four studies, in order: (route, condition, answer if it holds, answer otherwise).
# Answers are methods or votes: perm3 (the three orders of one graph method), graph5 (all graph methods), with_both,
# with_compress and with_vector (the three orders and the named baselines).
ROUTE_TABLES = {
    "confidence": [
        ("graph", "true", "graph_a", "graph_a"),
        ("gate", "true", "graph_gate", "graph_gate"),
        ("compress_if_unanimous_else_graph", "unanimous", "compress", "graph_a"),
        ("vector_if_unanimous_else_graph", "unanimous", "vector", "graph_a"),
        ("graph_if_unanimous_else_compress", "unanimous", "graph_a", "compress"),
        ("graph_if_unanimous_else_vector", "unanimous", "graph_a", "vector"),
        ("graph_vector_agree_else_compress", "graph_a = vector", "graph_a", "compress"),
        ("majority_plus_compress_vector", "true", "with_both", "with_both"),
        ("majority_plus_compress", "true", "with_compress", "with_compress"),
        ("majority_plus_vector", "true", "with_vector", "with_vector"),
    ],
    "breakthrough": [
        ("expand", "true", "graph_expand", "graph_expand"),
        ("expand_high_else_compress", "high", "graph_expand", "compress"),
        ("expand_high_else_vector", "high", "graph_expand", "vector"),
        ("expand_agrees_graph_else_compress", "graph_expand = graph_a", "graph_expand", "compress"),
        ("expand_agrees_gate_else_compress", "graph_expand = graph_gate", "graph_expand", "compress"),
        ("expand_agrees_any_graph_else_compress", "agreeing >= 1", "graph_expand", "compress"),
        ("expand_agrees_two_graph_else_compress", "agreeing >= 2", "graph_expand", "compress"),
        ("compress_if_unanimous_else_expand", "unanimous", "compress", "graph_expand"),
        ("expand_if_unanimous_else_compress", "unanimous", "graph_expand", "compress"),
        ("expand_if_graph_only_ge3_else_compress", "graph_only_chunks >= 3", "graph_expand", "compress"),
        ("expand_if_overlap_le50_else_compress", "rag_overlap <= 0.5", "graph_expand", "compress"),
        ("expand_if_relations_ge6_else_compress", "valid_relations >= 6", "graph_expand", "compress"),
    ],
    "graph_only": [
        ("expand", "true", "graph_expand", "graph_expand"),
        ("gate", "true", "graph_gate", "graph_gate"),
        ("perm3_majority", "true", "perm3", "perm3"),
        ("graph5_majority", "true", "graph5", "graph5"),
        ("expand_gate_agree_else_graph", "graph_expand = graph_gate", "graph_expand", "graph_a"),
        ("expand_gate_agree_else_perm3", "graph_expand = graph_gate", "graph_expand", "perm3"),
        ("expand_any_agree_else_perm3", "agreeing >= 1", "graph_expand", "perm3"),
        ("expand_two_agree_else_perm3", "agreeing >= 2", "graph_expand", "perm3"),
        ("expand_if_unstable_else_gate", "NOT unanimous", "graph_expand", "graph_gate"),
        ("gate_if_unstable_else_expand", "NOT unanimous", "graph_gate", "graph_expand"),
    ],
    "links": [
        ("expand", "true", "graph_expand", "graph_expand"),
        ("perm3", "true", "perm3", "perm3"),
        ("expand_high_else_perm3", "high", "graph_expand", "perm3"),
        ("expand_if_unstable_else_perm3", "NOT stable", "graph_expand", "perm3"),
        ("perm3_if_unanimous_else_expand", "stable", "perm3", "graph_expand"),
        ("expand_agrees_any_else_perm3", "graph_expand = graph_a OR graph_expand = graph_b OR graph_expand = graph_c", "graph_expand", "perm3"),
        ("expand_agrees_majority_else_perm3", "graph_expand = perm3", "graph_expand", "perm3"),
        ("expand_links6_else_perm3", "links >= 6", "graph_expand", "perm3"),
        ("expand_low_removed_else_perm3", "removed <= 2", "graph_expand", "perm3"),
        ("expand_margin_positive_else_perm3", "margin > 0", "graph_expand", "perm3"),
    ],
}
