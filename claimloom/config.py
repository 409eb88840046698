"""Tunable constants.  Every operator takes overrides for the ones it uses."""

from __future__ import annotations

# Thresholds, weights and caps of the matching and evidence rules.
TOP_K = 20
CANDIDATE_POOL = 40
MAX_REFERENCES = 5
HYBRID_WEIGHTS = {"semantic": 0.75, "keyword": 0.15, "numeric": 0.10}
FALLBACK_MIN_SEMANTIC = 0.82
FALLBACK_MIN_HYBRID = 0.70
FALLBACK_MIN_MARGIN = 0.01
FALLBACK_BYPASS = 0.03
FACT_MIN_SIMILARITY = 0.90
FACT_MIN_KEYWORDS = 2
CITATION_KEEP = 0.6
CITATION_ACCEPT = 0.85
LIBRARY_CITATION_MIN = 0.5
LCS_MIN_RATIO = 0.80
CHUNK_SIZE = 4800
CHUNK_OVERLAP = 800
DENSE_THRESHOLD = 120000
DENSE_CHUNK_SIZE = 3600
DENSE_CHUNK_OVERLAP = 600
SENTENCE_LOOKBACK = 240
FACT_CHUNK_SIZE = 24000
FACT_CHUNK_OVERLAP = 1200
FACTS_PER_PAGE = 10
NEAR_OVERLAP = 0.85
NEAR_SIMILARITY = 0.72
CARRY_FORWARD = 0.85
INVENTORY_MAX_CHARS = 18000
INVENTORY_FACT_CHARS = 260
CHARS_PER_PAGE = 3000
CACHE_TTL_DAYS = 30
CACHE_MAX_ROWS = 500
EVIDENCE_PRIORITY = {"table_cell": 4, "text_quote": 3, "figure_caption": 2, "chart_label": 1}
# end of fixed values

# Rows of either side of a nearest-neighbour block: bounds the memory of one task (some 64 MB a side at 64 dimensions).
KNN_BLOCK_ROWS = 131072
# Pairs worth a task of their own.
KNN_TASK_PAIRS = 1 << 22
# Queries and characters of words of a block in which needles are counted (see operators/holding.py).
HELD_BLOCK_QUERIES = 16384
HELD_BLOCK_CHARS = 8 << 20
# Bucketed random projections: tables, functions of a table, bucket width on unit vectors, borders a claim looks across.
LSH_TABLES = 20
LSH_FUNCTIONS = 6
LSH_WIDTH = 0.25
LSH_PROBES = 3
# Ways a hot join key is split (see operators/joins.py).
SALTS = 8
# Claims of a page beyond which it is walked component by component (see operators/dedup.py).
CROWDED_PAGE = 4096
