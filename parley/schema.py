"""Column types and fixed values of the conversation engine."""

from __future__ import annotations

# Categories in their order, and the defaults of the measures.
CATEGORIES = ("ppron", "ipron", "casepart", "auxverb", "adverb", "conj", "negate")
MICRO_CATEGORIES = ("i", "we", "you", "shehe", "they")
EPS = 1e-4
ZERO_TOL = 0.0
ROLLING_WINDOW = 8
MIN_TURN_WORDS = 3
IMPUTED = 0.5
WINDOW_MINUTES = 5.0

CSV_TURNS = "speaker string, text string, start double, end double"
