"""Tokenisers of the user's own, such as a language model with lemmas and parts of speech.

The factory is called once for each task, where the texts are, so a heavy model is loaded there and
nothing but the factory is shipped.  It returns a function from a text to tokens.  Tokens become Arrow columns
after a bounded number of characters, since as Python objects they take many times the room of their text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENS = "array<struct<text:string,lemma:string,pos:string,is_space:boolean,is_punct:boolean>>"
#: Parts of speech that are no words.
NO_WORDS = ("PUNCT", "SYM")
#: Characters of texts, about, whose tokens are Python objects at a time; a longer text is taken whole.
PIECE_CHARS = 1 << 17

KIND = pa.list_(pa.struct([(k, pa.string()) for k in ("text", "lemma", "pos")] + [(k, pa.bool_()) for k in ("is_space", "is_punct")]))
NO_TOKEN = {"text": None, "lemma": None, "pos": None, "is_space": False, "is_punct": False}


def pieces(texts: pa.Array, tokens: Callable[[str], Iterable[dict]]) -> Iterator[pa.Array]:
    """The tokens of the texts in arrays of bounded size."""
    rows, chars = [], 0
    for text in texts:
        t = text.as_py()
        rows.append([NO_TOKEN | x for x in tokens(t)] if t else [])
        chars += len(t or "")
        if chars >= PIECE_CHARS:
            yield pa.array(rows, KIND, from_pandas=True)
            rows, chars = [], 0
    yield pa.array(rows, KIND, from_pandas=True)


def tokeniser(factory: Callable[[], Callable[[str], Iterable[dict]]]) -> Callable[[Column], Column]:
    """A function of columns from text to tokens with text, lemma, pos, is_space and is_punct; null text has none."""

    @F.arrow_udf(TOKENS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = factory()
        for texts in batches:
            yield pa.concat_arrays(list(pieces(texts, tokens)))

    return run


def words_of(tokens: Column) -> Column:
    """The lemmas (a missing one is the token's text) of tokens that are neither space nor punctuation nor symbols."""
    real = F.filter(
        tokens,
        lambda t: ~F.coalesce(t["is_space"], F.lit(False)) & ~F.coalesce(t["is_punct"], F.lit(False)) & ~F.coalesce(t["pos"], F.lit("")).isin(*NO_WORDS)
    )
    return F.transform(real, lambda t: F.coalesce(F.nullif(t["lemma"], F.lit("")), t["text"]))
