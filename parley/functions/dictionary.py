"""Category dictionaries: patterns of words, with `*` for any characters, and their categories."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"


@dataclass(frozen=True)
class Dictionary:
    """(pattern, categories) in the file's order; a token's categories are those of all patterns that fit it whole."""

    entries: tuple[tuple[str, tuple[str, ...]], ...]
    labels: tuple[str, ...] = field(default=())

    @classmethod
    def of(cls, words: dict[str, Iterable[str]]) -> Dictionary:
        """From category -> patterns."""
        found: dict[str, list[str]] = {}
        for category, patterns in words.items():
            for pattern in patterns:
                found.setdefault(pattern, []).append(category)
        return cls(tuple((p, tuple(c)) for p, c in found.items()), tuple(words))

    @classmethod
    def parse(cls, text: str) -> Dictionary:
        """From a two-section text: a line with `%`, `id label` lines, another `%`, then `pattern id ...` lines."""
        section, labels, rows = 0, {}, []
        for line in text.splitlines():
            line = line.strip()
            if line.startswith("#") or not (line := line.split("#", 1)[0].strip()):
                continue
            if line.startswith("%") and section < 2:
                section += 1
            elif section == 1:
                key, label = line.split(None, 1)
                labels[key] = label.strip()
            elif section == 2 and len(parts := line.split()) > 1:
                rows.append((parts[0], parts[1:]))
        entries = ((p, tuple(dict.fromkeys(labels[i] for i in ids if i in labels))) for p, ids in rows)
        return cls(tuple((p, c) for p, c in entries if c), tuple(dict.fromkeys(labels.values())))

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Dictionary:
        """A dictionary file at any path that Spark reads."""
        rows = spark.read.text(path, wholetext=True).limit(1).collect()
        return cls.parse(rows[0][0] if rows else "")

    def only(self, categories: Iterable[str]) -> Dictionary:
        """Without other categories and patterns that then have none; raises if nothing is left."""
        wanted = tuple(c for c in categories if c in self.labels)
        if not wanted:
            raise RuntimeError("no wanted category is in the dictionary")
        kept = ((p, tuple(c for c in cs if c in wanted)) for p, cs in self.entries)
        return Dictionary(tuple((p, c) for p, c in kept if c), wanted)

    def lowered(self) -> Dictionary:
        return Dictionary(tuple((p.lower(), c) for p, c in self.entries), self.labels)

    def fits(self, token: Column, categories: Iterable[str]) -> Column:
        """Whether a token fits a pattern of one of the categories, by looking up the token and its ends.

        Patterns with one `*` are looked up by the token's first and last letters, for each pair of lengths that
        occurs; only those with more are tried by a regular expression.
        """
        wanted = set(categories)
        exact, ends, others = [], {}, []
        for pattern in dict.fromkeys(p for p, c in self.entries if wanted.intersection(c)):
            first, *rest = pattern.split("*")
            if not rest:
                exact.append(pattern)
            elif len(rest) == 1:
                ends.setdefault((len(first), len(rest[0])), []).append((first, rest[0]))
            else:
                others.append(regex_of(pattern))
        out = among(token, exact) if exact else F.lit(False)
        for (a, b), found in ends.items():
            enough = F.length(token) >= a + b
            if a and b:
                fit = enough & among(ends_of(token, a, b), [f"{x}*{y}" for x, y in found])
            elif a or b:
                fit = enough & among(F.substring(token, 1, a) if a else F.substring(token, -b, b), [x or y for x, y in found])
            else:
                fit = enough
            out = out | fit
        return out | token.rlike("|".join(others)) if others else out

    def table(self, spark: SparkSession) -> DataFrame:
        """(category, key, a, b, regex): a token fits if its first a and last b letters, or the whole of it (a null), are the key.

        With a regex it has to fit that too.  Its size is known to the planner, which broadcasts it if it is small.
        """
        rows = {k: [] for k in ("category", "key", "a", "b", "regex")}
        for pattern, categories in self.entries:
            parts = pattern.split("*")
            star = len(parts) > 1
            for category in categories:
                one = (
                    category, f"{parts[0]}*{parts[-1]}" if star else pattern, len(parts[0]) if star else None,
                    len(parts[-1]) if star else None, regex_of(pattern) if len(parts) > 2 else None
                )
                for k, v in zip(rows, one, strict=True):
                    rows[k].append(v)
        kinds = dict.fromkeys(rows, pa.string()) | {"a": pa.int32(), "b": pa.int32()}
        return spark.createDataFrame(pa.table({k: pa.array(v, kinds[k]) for k, v in rows.items()}))


def among(token: Column, values: list[str]) -> Column:
    """token.isin(values), handed to the JVM in one call where there are many."""
    if len(values) <= 64 or not hasattr(token, "_jc") or any("\0" in v for v in values):
        return token.isin(values)
    listed = SparkSession.active()._jvm.java.util.regex.Pattern.compile("\0").splitAsStream("\0".join(sorted(values))).toList()
    return type(token)(token._jc.isInCollection(listed))


def regex_of(pattern: str) -> str:
    return "^(?s:" + ".*".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", x) for x in pattern.split("*")) + ")$"


def ends_of(token: Column, a: int | Column, b: int | Column) -> Column:
    """The first a and the last b letters of a token, as keys of patterns have them."""
    return F.concat(F.left(token, a if isinstance(a, Column) else F.lit(a)), F.lit("*"), F.right(token, b if isinstance(b, Column) else F.lit(b)))


#: Frequent function words of four languages; one word may be in several categories.
SAMPLE = Dictionary.of(
    {
        "ppron": ["i", "we", "you", "he", "she", "they", "je", "nous", "vous", "ich", "wir", "sie", "yo", "el", "no*otros"],
        "ipron": ["it", "this", "that", "which", "ce*", "qui", "das", "esto", "que", "was", "*thing"],
        "casepart": [
            "of", "to", "in", "for", "on", "with", "by", "from", "de", "des", "du", "dans", "par", "sur", "von", "mit", "zu",
            "auf", "para", "con"
        ],
        "auxverb": ["is", "are", "was", "be", "have", "est", "sont", "ist", "sind", "es", "ha*en"],
        "adverb": ["not", "very", "here", "there", "pas", "plus", "nicht", "auch", "muy", "th*re"],
        "conj": ["and", "or", "but", "as", "et", "ou", "mais", "und", "oder", "als", "y", "pero"],
        "negate": ["no", "not", "never", "pas", "ne", "nicht", "kein*", "nunca"],
        "i": ["i", "je", "ich", "yo"],
        "we": ["we", "nous", "wir", "no*otros"],
        "you": ["you", "vous", "tu"],
        "shehe": ["he", "she", "el", "elle"],
        "they": ["they", "sie", "ellos"],
    }
)
