"""Fixed values that results depend on."""

# --- fixed values: label fields and their published order -------------------
SELECTION_FIELDS = [
    "content_quality", "pii_presence", "content_type", "information_density",
    "educational_value", "content_safety", "content_integrity",
    "reasoning_indicators", "content_ratio", "content_length",
]
COMPACT_FIELDS = [
    "content_quality", "pii_presence", "content_integrity", "content_ratio",
    "content_length", "information_density", "educational_value",
    "reasoning_indicators", "content_safety",
]
MULTI_LABEL_FIELDS = ["content_type"]
QUALITY_LABELS = ["unacceptable", "poor", "adequate", "good", "excellent"]
MISSING = "__missing__"
MAX_TOKEN_BOUND = 100_000_000

# --- fixed values: browse columns -------------------------------------------
ROW_COLUMNS = [
    "record_no", "id", "source", "domain", "token_count", "added", "created",
    "source_row", "one_sentence_description", "content_quality",
    "pii_presence", "content_type",
]

# --- fixed values: length histogram edges -----------------------------------
LENGTH_EDGES = [0] + [2 ** p for p in range(4, 26)]
POWER_EDGES = [0] + [2 ** p for p in range(4, 33)]

# --- fixed values: search and paging ----------------------------------------
BM25_K1 = 1.2
BM25_B = 0.75
PAGE_SIZE = 30
PREVIEW_CHARS = 700
SNIPPET_LEAD = 110
TITLE_CHARS = 130
PART_CHARS = 100_000
MAX_RESULTS = 300
RERANK_CANDIDATES = 1200
IVF_CANDIDATES = 2400
PQ_CANDIDATES = 300
COSINE_WEIGHT = 0.45
COVERAGE_WEIGHT = 0.55
VOCAB_RANK_OFFSET = 500
SEED = 42

# --- fixed values: topics ---------------------------------------------------
TOPIC_SAMPLE_PER_SOURCE = 500
TOPIC_MIN_CLUSTER = 40
TOPIC_MAX = 28
TOPIC_MIN_DF = 5
TOPIC_MAX_DF_SHARE = 0.5
TOPIC_KEYWORDS = 10
TOPIC_LABEL_MIN_POINTS = 20

# --- fixed values: Danish function words left out of topic keywords ----------
TOPIC_STOP_WORDS = """
ad af alle alt anden andet andre at bare begge blev bliver da de dem den
denne dens der deres det dette dig din dine disse dog du efter eller en end
ene eneste enhver er et få fik flere flest fordi fra før først gennem gøre
gør gjorde god ham han hans har havde have hende hendes her hos hun hvad
hvem hver hvilken hvilke hvis hvor hvordan hvorfor hvornår i ikke ind ingen
intet jeg jer jeres jo kan kom komme kunne lad lidt lige man mange med meget
men mens mere mig min mine mit mod må mellem ned nej noget nogen nogle nok
nu når og også om op os over på samme sammen selv sig sin sine sit skal
skulle som sådan så thi til ud uden under var ved vi vil ville vor være
været år være www http https com dk samt dels blandt siden både nemlig dog
kun
""".split()
