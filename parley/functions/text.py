"""Cleaning and splitting of transcript texts."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.names import stripped

# Descriptions of sounds, which brackets may hold instead of speech.
DROP_WORDS = (
    "笑", "拍手", "音楽", "bgm", "se", "効果音", "咳", "咳払い", "ため息", "ノイズ", "雑音", "聞き取れず", "不明", "沈黙", "無音",
    "laugh", "applause", "music", "noise", "cough", "sigh", "inaudible", "silence",
)
BRACKETS = ((r"\[", r"\]"), ("［", "］"), ("【", "】"))


def without_brackets(text: Column, mode: str = "unwrap", drop_words: Iterable[str] = DROP_WORDS) -> Column:
    """Bracketed words kept without brackets (unwrap) or dropped (drop_all); descriptions are always dropped.

    A description with more brackets inside, such as [[laugh], is one only where it follows its bracket directly.
    """
    if mode == "off":
        return text
    if mode not in ("unwrap", "drop_all"):
        raise ValueError(f"mode {mode!r}")
    words = "|".join(map(re.escape, drop_words))
    out = text
    for left, right in BRACKETS:
        if mode == "unwrap":
            out = F.regexp_replace(out, rf"(?iuU){left}\s*(?:{words})\s*{right}", "")
            out = F.regexp_replace(out, f"{left}(.*?){right}", "$1")
        else:
            out = F.regexp_replace(out, f"{left}.*?{right}", "")
    out = F.regexp_replace(out, r"[\[\]［］【】]", "")
    return stripped(F.regexp_replace(out, r"(?U)\s+", " "))


def bracket_counts(text: Column, drop_words: Iterable[str] = DROP_WORDS) -> tuple[Column, Column]:
    """(kept, deleted) brackets of the unwrap mode."""
    words = "|".join(map(re.escape, drop_words))
    every, dropped = F.lit(0), F.lit(0)
    for left, right in BRACKETS:
        every = every + F.regexp_count(text, F.lit(f"{left}.*?{right}"))
        dropped = dropped + F.regexp_count(text, F.lit(rf"(?iuU){left}\s*(?:{words})\s*{right}"))
    return (every - dropped).cast("long"), dropped.cast("long")


def clean_or_raw(clean: Column, raw: Column) -> Column:
    """The cleaned text unless it is blank."""
    return F.coalesce(F.when(stripped(clean) != "", clean), raw)


def joined(texts: Column, order: Column, skip_null: bool = False) -> Column:
    """An aggregate: the group's texts in order, with single spaces between."""
    rows = F.array_sort(
        F.collect_list(
            F.when(
                texts.isNotNull(), F.struct(order.alias("at"), texts.alias("text"))
            ) if skip_null else F.struct(order.alias("at"), texts.alias("text"))
        )
    )
    return F.array_join(F.transform(rows, lambda x: x["text"]), " ")
