"""Both measures on a few turns: python examples/tutorial.py"""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import SparkSession

from parley.functions.dictionary import SAMPLE
from parley.operators import features, responsiveness, similarity
from parley.schema import CATEGORIES

TALK = [
    (1, 0, "ann", "I think that it is not here, and you know that"),
    (1, 1, "bob", "you are right, it was in the house of the man"),
    (1, 2, "ann", "but was it there with the others, or not?"),
    (1, 3, "bob", "it was there, and we saw it"),
]


def main() -> None:
    spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").getOrCreate()
    turns = spark.createDataFrame(TALK, "conv_id long, turn long, speaker string, text string")
    counts = features.turn_counts(turns, SAMPLE, CATEGORIES)
    similarity.conversation_similarity(counts, ("ann", "bob"), CATEGORIES).show(truncate=False)
    pairs = responsiveness.exchanges(responsiveness.with_rates(counts, CATEGORIES), CATEGORIES)
    own = responsiveness.individuals(pairs, CATEGORIES)
    responsiveness.overall(own, CATEGORIES).show()
    responsiveness.dyads(counts, own, CATEGORIES, "nanmean").select("conv_id", "dyad_final").show()
    spark.stop()


if __name__ == "__main__":
    main()
