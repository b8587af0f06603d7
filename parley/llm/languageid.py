"""Language ID by unigram pieces, with all segmentations of a word summed.

The pieces are those of a fixed public vocabulary (lower-cased, letters only, with the mark of a word's
start as a space) and every single byte, so that any word has a segmentation.  A word is a longest run of
ASCII letters and non-ASCII bytes, of any length.  Per language, expectation maximisation over the words of
a bounded, documented sample of the rows that may be learnt from fits the pieces' probabilities.  A text's
likelihood is the product over its words of the forward algorithm's sum; the score is the posterior of the
best language.

Pieces are found from their ends: a table holds every ending of a piece, so a search stops where no piece
goes on.  Sums of long words are kept in range by factors that are taken out as they go.

Defined cases: null text or text without any letter is `und` with score 0; with nothing to learn from
every text is; each labelled row teaches its own language, though ids repeat; repeated rows each get their
row; ties go to the first language by name; extra columns, whatever their names, are not read; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import chunks, filtered, held_out, lean, strings, table
from parley.llm.textkernel import CODES, LOWER, U, powers, runs, span_hashes

#: Documents that the probabilities are fitted on, taken in the order of a hash of the id.
TRAIN_ROWS = 3_000
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
VOCABULARY = "piece_bpe_32k.model"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass(frozen=True)
class Pieces:
    """Hashes of all endings of pieces, sorted, and which piece each is (-1: none itself); pieces count from 0."""

    endings: np.ndarray
    piece: np.ndarray
    count: int
    longest: int

    @classmethod
    def of(cls, names: list[bytes]) -> Pieces:
        found: dict[bytes, int] = {}
        for i, name in enumerate(names):
            for k in range(1, len(name)):
                found.setdefault(name[k:], -1)
            found[name] = i
        flat = np.frombuffer(b"".join(found), np.uint8)
        ends = np.cumsum([len(x) for x in found])
        place = ends.repeat([len(x) for x in found]) - 1 - np.arange(len(flat))  # from the end of each
        hashes = np.add.reduceat(CODES[flat] * powers(int(place.max()) + 1)[0][place], np.append(0, ends[:-1]))
        order = np.argsort(hashes)
        return cls(hashes[order], np.array(list(found.values()), np.int32)[order], len(names), max(map(len, names)))


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """The vocabulary's pieces of letters and all single bytes."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    found = {bytes([b]) for b in (0x20, *np.flatnonzero(LETTER).tolist())}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode().lower()
        body = piece[1:] if piece[:1] == b" " else piece
        if body and LETTER[list(body)].all():
            found.add(piece)
    return Pieces.of(sorted(found))


def matrix(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A space and the bytes of each word, zeros after; and the lengths with the space."""
    sizes = ends - starts
    width = int(sizes.max()) + 1
    out = np.zeros((len(starts), width), np.uint8)
    out[:, 0] = 0x20
    columns = np.arange(width - 1)
    inside = columns < sizes[:, None]
    out[:, 1:][inside] = data[(starts[:, None] + columns)[inside]]
    return out, sizes + 1


def lattice(words: np.ndarray, sizes: np.ndarray, p: Pieces) -> Iterator[tuple[int, list[tuple[int, np.ndarray, np.ndarray]]]]:
    """For each end position: (end, [(piece length, rows that have the piece there, piece numbers)])."""
    up = powers(p.longest)[0]
    columns = np.ascontiguousarray(CODES[words].T)
    for end in range(1, words.shape[1] + 1):
        rows = np.flatnonzero(sizes >= end)
        key, found = np.zeros(len(rows), U), []
        for length in range(1, min(end, p.longest) + 1):
            key = key + columns[end - length][rows] * up[length - 1]
            at = np.minimum(np.searchsorted(p.endings, key), len(p.endings) - 1)
            hit = p.endings[at] == key
            rows, key, ids = rows[hit], key[hit], p.piece[at[hit]]
            if not len(rows):
                break
            whole = ids >= 0
            if whole.any():
                found.append((length, rows[whole].astype(np.int32), ids[whole]))
        yield end, found


def log_sums(words: np.ndarray, sizes: np.ndarray, p: Pieces, probability: np.ndarray) -> np.ndarray:
    """Per row and language the log of the summed probability of all segmentations of the row's bytes."""
    ring = p.longest + 1
    alpha = np.zeros((ring, len(words), probability.shape[1]))  # of the last ends only
    alpha[0] = 1.0
    taken = np.zeros(alpha.shape[1:])
    out = np.zeros_like(taken)
    for end, found in lattice(words, sizes, p):
        here = alpha[end % ring]
        here[:] = 0.0
        for length, rows, ids in found:
            here[rows] += alpha[(end - length) % ring][rows] * probability[ids]
        done = np.flatnonzero(sizes == end)
        out[done] = np.log(here[done]) + taken[done]
        if end % 8 == 0:
            live = np.flatnonzero(sizes > end)
            factor = here[live]
            taken[live] += np.log(factor)
            alpha[:, live] /= factor
    return out


def by_size(sizes: np.ndarray, cells: int = 1 << 17) -> Iterator[np.ndarray]:
    """Positions in runs of similar sizes, each of about so many cells as a matrix (or a single word)."""
    order = np.argsort(sizes, kind="stable")
    lo = 0
    while lo < len(order):
        limit = max(8, int(sizes[order[lo]]) * 3 // 2)
        hi = int(np.searchsorted(sizes[order], limit, "right"))
        hi = min(hi, lo + max(1, cells // (limit + 1)))
        yield order[lo:hi]
        lo = hi


def letter_runs(data: np.ndarray, offsets: np.ndarray):
    """(starts, ends, text number) of the words in lower-cased bytes."""
    starts, ends = runs(LETTER[data], offsets)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    path: str
    probability: np.ndarray
    prior: np.ndarray

    def likelihoods(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log likelihood of each text in each language."""
        n, low = len(offsets) - 1, LOWER[data]
        out = np.tile(self.prior, (n, 1))
        starts, ends, doc = letter_runs(low, offsets)
        if not len(starts):
            return out
        _, first, back = np.unique(span_hashes(CODES[low], starts, ends), return_index=True, return_inverse=True)
        logs, p = np.empty((len(first), len(self.languages))), pieces(self.path)
        for rows in by_size(ends[first] - starts[first]):
            logs[rows] = log_sums(*matrix(low, starts[first[rows]], ends[first[rows]]), p, self.probability)
        for k in range(len(self.languages)):
            out[:, k] += np.bincount(doc, logs[back, k], n)
        return out


def expected_counts(steps: list, sizes: np.ndarray, often: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """How often each piece is expected in words that occur `often`, given the pieces' log probabilities."""
    at = np.arange(len(sizes))
    alpha = np.full((int(sizes.max()) + 1, len(sizes)), -np.inf)
    alpha[0] = 0.0
    for end, found in steps:
        for length, rows, ids in found:
            alpha[end][rows] = np.logaddexp(alpha[end][rows], alpha[end - length][rows] + logs[ids])
    beta = np.full_like(alpha, -np.inf)
    beta[sizes, at] = -alpha[sizes, at]
    out = np.zeros(len(logs))
    for end, found in reversed(steps):
        for length, rows, ids in found:
            flow = beta[end][rows] + logs[ids]
            out += np.bincount(ids, np.exp(alpha[end - length][rows] + flow) * often[rows], len(logs))
            beta[end - length][rows] = np.logaddexp(beta[end - length][rows], flow)
    return out


def fit(counts: dict[str, dict[bytes, int]], path: str, shares: dict[str, int], rounds: int = 4) -> Model | None:
    """counts: per language its words (lower-cased) and how often each occurs."""
    languages = tuple(sorted(k for k in counts if counts[k]))
    if not languages:
        return None
    p = pieces(path)
    table_ = np.full((p.count, len(languages)), 1.0 / p.count)
    for k, language in enumerate(languages):
        names = list(counts[language])
        often, lengths = np.array([counts[language][w] for w in names], float), np.array(list(map(len, names)))
        ends = np.cumsum(lengths)
        flat = np.frombuffer(b"".join(names), np.uint8)
        groups = []
        for rows in by_size(lengths):
            words, sizes = matrix(flat, (ends - lengths)[rows], ends[rows])
            groups.append((list(lattice(words, sizes, p)), sizes, often[rows]))
        for _ in range(rounds):
            logs = np.log(table_[:, k])
            expected = 0.05 + sum(expected_counts(*g, logs) for g in groups)
            table_[:, k] = expected / expected.sum()
    share = np.array([shares[x] for x in languages], float)
    return Model(languages, path, table_, np.log(share / share.sum()))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each chunk, by language, with counts; and under the empty word the texts."""
    for batch in batches:
        for lo, hi, data, offsets in chunks(batch.column("text")):
            low = LOWER[data]
            starts, ends, doc = letter_runs(low, offsets)
            names, language = np.unique(np.array(batch.column("lang").slice(lo, hi - lo).to_pylist(), object).astype(str), return_inverse=True)
            out = [(names[i], b"", int((language == i).sum())) for i in range(len(names))]
            for i, name in enumerate(names):
                mine = language[doc] == i
                if mine.any():
                    _, first, n = np.unique(span_hashes(CODES[low], starts[mine], ends[mine]), return_index=True, return_counts=True)
                    out += [(name, low[s:e].tobytes(), int(c)) for s, e, c in zip(starts[mine][first], ends[mine][first], n, strict=True)]
            a, b, c = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(list(map(str, a))), pa.array(b, pa.binary()), pa.array(c, pa.int64())], ["lang", "word", "n"])


def train(docs: DataFrame, rows: int = TRAIN_ROWS, path: str | None = None) -> Model | None:
    """Fits a model on at most `rows` documents with a language and text that aren't held out."""
    known = docs.select("doc_id", "lang").where("lang is not null and doc_id is not null").where(~held_out()).select("doc_id").distinct()
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.where("text is not null and lang is not null").select("doc_id", "lang", "text")
    texts = texts.join(F.broadcast(some.select("doc_id")), "doc_id", "left_semi").select("lang", "text")
    found = texts.mapInArrow(lean(_word_counts), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, dict[bytes, int]] = {}
    shares: dict[str, int] = {}
    for language, word, n in zip(*(found.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
        if word:
            counts.setdefault(language, {})[word] = n
        else:
            shares[language] = n
    return fit(counts, path or vocabulary_path(), shares)


def predicted(column: pa.Array, model: Model | None) -> tuple[np.ndarray, np.ndarray]:
    """(language, score) of each text of a column."""
    names = np.array([*(model.languages if model else ()), "und"], object)
    texts = strings(column)
    best, p = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
    for lo, hi, data, offsets in chunks(texts) if model else ():
        ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128)
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(ascii_letter, out=sums[1:])
        ok = sums[offsets[1:]] > sums[offsets[:-1]]
        for i in np.flatnonzero(~ok & (offsets[1:] > offsets[:-1])):
            ok[i] = any(map(str.isalpha, texts[lo + int(i)].as_py()))
        logs = model.likelihoods(data, offsets)
        logs -= logs.max(1, keepdims=True)
        np.exp(logs, out=logs)
        best[lo:hi][ok], p[lo:hi][ok] = logs.argmax(1)[ok], (1 / logs.sum(1))[ok]
    return names[best], p


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, p = predicted(batch.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(p)], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """The rows, all their columns, whose text has a language with a score of `least` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(texts: pa.Array) -> np.ndarray:
        names, p = predicted(texts, shared.value)
        return (names != "und") & (p >= least)

    return filtered(docs, keep)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
