"""Conversation style coordination on PySpark: dictionaries, measures, repair of transcripts, whole studies."""

from parley.functions.dictionary import Dictionary
from parley.functions.scoring import responsiveness, similarity
from parley.operators.features import match_tokens, token_counts, turn_counts
from parley.operators.responsiveness import dyads, exchanges, individual_spine, individuals, overall
from parley.operators.responsiveness import summary as responsiveness_summary
from parley.operators.rolling import rolling_pairs, rolling_rates
from parley.operators.similarity import conversation_similarity, temporal_similarity, text_pair_similarity
from parley.operators.unitize import unitized

__all__ = [
    "Dictionary", "conversation_similarity", "dyads", "exchanges", "individual_spine", "individuals", "match_tokens", "overall", "responsiveness",
    "responsiveness_summary", "rolling_pairs", "rolling_rates", "similarity", "temporal_similarity", "text_pair_similarity", "token_counts", "turn_counts", "unitized",
]
