"""Byte-pair encoding and decoding over a minimal acyclic transducer of frequent words.

Texts are normalised and cut into words as the vocabulary file says, by the library's own normaliser and
character classes, so that no result depends on the Unicode tables of an executor's Python.  Frequent words, counted over the
whole corpus in bounded memory, are compiled into one automaton whose equal suffixes are shared; numbers
on its edges add up to a word's rank among them, and the rank leads to its ids.  The automaton is one
block of bytes that each worker memory-maps.  Words that it lacks are merged exactly, many at a time.

Defined cases: null text is empty and has no ids; the special tokens' strings in a text become their
ids, as the library does; repeated rows each get their row; extra columns are not read; an empty table
gives no rows; texts and words of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import lean, strings, table
from parley.llm.textkernel import U, mix, span_hashes

VOCABULARY = "word_bpe_49k.json"
#: Words of the lexicon, and words that one task's summary of counts holds at most.  Neither changes a result.
LEXICON_WORDS = 1 << 16
SUMMARY_WORDS = 1 << 16
#: Words that a memo holds at most; it starts anew when full.
MEMO_WORDS = 400_000
CHUNK = 1 << 21
LONG_WORD = 128
#: Texts of these characters alone are their own normal form but for case, which Python's tables have as the library does;
#: all other texts go through the library's normaliser.
PLAIN = "\x00-\u02ff\u0400-\u0481\u048a-\u052f\u2010-\u2027\u2030-\u205e\u20ac\u3001-\u3029\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fef\uff01-\uff5e"
NOT_PLAIN = re.compile(f"[^{PLAIN}]")
NONE, LETTER, DIGIT, OTHER = range(4)
NEVER = np.int32(2**31 - 1)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """NONE (white space), LETTER, DIGIT or OTHER for each code point, by the library's own regular expressions."""
    from tokenizers import Regex, pre_tokenizers

    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    every = points.astype("<u4").tobytes().decode("utf-32-le")
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (NONE, r"\s+")):
        for _, (start, end) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every):
            out[points[start:end]] = kind
    return out


@lru_cache(maxsize=2)
def normaliser(path: str):
    """The library's normaliser of a vocabulary file: a function of a text."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).normalizer.normalize_str


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Ids of bytes and merges, as arrays."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids, suffix = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([ids[x] for x in letters], np.int32)
        self.last = np.array([ids[x + suffix] for x in letters], np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int32)
        self.lookup = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        names = {i: t for t, i in (*ids.items(), *self.special.items())}
        tokens = [names.get(i, "").encode() + b" " for i in range(max(names) + 1)]
        self.token_at = np.cumsum([0, *map(len, tokens)])
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Each pair's place among the merges, NEVER for others; negative ids pair with nothing."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NEVER)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_one(v: Vocabulary, word: bytes) -> list[int]:
    """Exact merges of one word of any length: a heap of pairs over a linked list."""
    ids = [*v.inner[list(word[:-1])].tolist(), int(v.last[word[-1]])]
    after, before, alive = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)], [True] * len(ids)
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := v.lookup.get(ids[i] << 32 | ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
            continue
        ids[i], alive[j], after[i] = int(v.merged[r]), False, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y >= 0 and (q := v.lookup.get(ids[x] << 32 | ids[y])) is not None:
                heapq.heappush(heap, (q, x, ids[x], ids[y]))
    return [x for x, ok in zip(ids, alive, strict=True) if ok]


def merge_many(v: Vocabulary, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact merges of words of up to LONG_WORD bytes: (ids in a matrix, how many of each row)."""
    width = int(sizes.max())
    columns = np.arange(width)
    inside = columns < sizes[:, None]
    ids = np.full((len(sizes), width + 1), -1, np.int32)
    ids[:, :width][inside] = v.inner[flat[(starts[:, None] + columns)[inside]]]
    ids[np.arange(len(sizes)), sizes - 1] = v.last[flat[starts + sizes - 1]]
    rank = np.full((len(sizes), width + 1), NEVER, np.int32)
    both = inside[:, 1:]
    rank[:, : width - 1][both] = v.ranks(ids[:, : width - 1][both], ids[:, 1:width][both])
    out, left = np.full_like(ids, -1), sizes.astype(np.int64).copy()
    live, rows = np.arange(len(sizes)), np.arange(len(sizes))
    while len(rows):
        k = rank.argmin(1)
        at = np.arange(len(rows))
        best = rank[at, k]
        ended = best == NEVER
        if ended.any():
            out[rows[ended]] = ids[ended]
            live = ~ended
            ids, rank, rows, k, best = ids[live], rank[live], rows[live], k[live], best[live]
            if not len(rows):
                break
            at = np.arange(len(rows))
        shift = np.minimum(np.arange(width + 1) + (np.arange(width + 1) > k[:, None]), width)
        ids = np.take_along_axis(ids, shift, 1)
        rank = np.take_along_axis(rank, shift, 1)
        ids[at, k] = v.merged[best]
        left[rows] -= 1
        rank[at, k] = v.ranks(ids[at, k], ids[at, np.minimum(k + 1, width)])
        some = k > 0
        rank[at[some], k[some] - 1] = v.ranks(ids[at[some], k[some] - 1], ids[at[some], k[some]])
    return out, left


def merged(v: Vocabulary, names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words in a row, how many each has), by exact merges."""
    sizes = np.fromiter(map(len, names), np.int64, len(names))
    flat = np.frombuffer(b"".join(names), np.uint8)
    starts = np.cumsum(sizes) - sizes
    count = np.zeros(len(names), np.int64)
    found = []
    for lo, hi in ((0, 4), (4, 8), (8, 12), (12, 20), (20, 48), (48, LONG_WORD)):
        rows = np.flatnonzero((sizes > lo) & (sizes <= hi))
        if len(rows):
            ids, n = merge_many(v, flat, starts[rows], sizes[rows])
            count[rows] = n
            found.append((rows, ids[np.arange(ids.shape[1]) < n[:, None]], n))
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        ids = merge_one(v, names[i])
        count[i] = len(ids)
        found.append((np.array([i]), np.array(ids, np.int32), np.array([len(ids)])))
    out, begin = np.empty(int(count.sum()), np.int32), np.cumsum(count) - count
    for rows, ids, n in found:
        out[spread(begin[rows], n)] = ids
    return out, count


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each span, one after another."""
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


class Lexicon:
    """A minimal acyclic automaton of words with a number on each edge, and the ids of each rank.

    One block of bytes: five sizes, then edge keys (state << 8 | byte), their targets and numbers, the
    states' final marks, the ids' offsets by rank, and the ids.
    """

    KINDS = (np.int64, np.int32, np.int32, np.uint8, np.int32, np.int32)

    def __init__(self, block: np.ndarray):
        sizes = block[:48].view(np.int64)
        at, parts = 48, []
        for n, kind in zip(sizes.tolist(), self.KINDS, strict=True):
            parts.append(block[at : at + n * np.dtype(kind).itemsize].view(kind))
            at += (n * np.dtype(kind).itemsize + 7) // 8 * 8
        self.keys, self.target, self.number, self.final, self.at, self.ids = parts

    @classmethod
    def opened(cls, block: bytes) -> Lexicon:
        """Memory-mapped from a file of this worker's own, which is gone when the worker ends."""
        with tempfile.TemporaryFile() as f:
            f.write(block)
            f.flush()
            return cls(np.memmap(f, np.uint8, "r"))

    @staticmethod
    def compiled(v: Vocabulary, names: list[bytes]) -> bytes:
        names = sorted({n for n in names if n})
        edges: list[dict[int, int]] = [{}]
        final = [False]
        known: dict[tuple, int] = {}
        path: list[int] = [0]
        last = b""

        def settle(depth: int) -> None:
            """States below `depth` of the last word won't change: equal ones become one."""
            for i in range(len(last), depth, -1):
                state = path[i]
                form = (final[state], tuple(edges[state].items()))
                edges[path[i - 1]][last[i - 1]] = known.setdefault(form, state)

        for name in names:
            common = next((i for i, (a, b) in enumerate(zip(name, last, strict=False)) if a != b), min(len(name), len(last)))
            settle(common)
            del path[common + 1 :]
            for byte in name[common:]:
                edges.append({})
                final.append(False)
                edges[path[-1]][byte] = len(edges) - 1
                path.append(len(edges) - 1)
            final[path[-1]] = True
            last = name
        settle(0)
        order: dict[int, int] = {0: 0}
        queue = [0]
        for state in queue:
            for to in edges[state].values():
                if to not in order:
                    order[to] = len(order)
                    queue.append(to)
        below: dict[int, int] = {}
        done: list[tuple[int, bool]] = [(0, False)]
        while done:
            state, seen = done.pop()
            if state in below:
                continue
            if seen:
                below[state] = final[state] + sum(below[to] for to in edges[state].values())
            else:
                done.append((state, True))
                done += [(to, False) for to in edges[state].values()]
        keys, target, number = [], [], []
        for state in queue:
            n = int(final[state])
            for byte, to in sorted(edges[state].items()):
                keys.append(order[state] << 8 | byte)
                target.append(order[to])
                number.append(n)
                n += below[to]
        ids, count = merged(v, names) if names else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        parts = [
            np.array(x, kind) for x,
            kind in zip((keys, target, number, [final[s] for s in queue], np.cumsum([0, *count]), ids), Lexicon.KINDS, strict=True)
        ]
        block = np.array([len(p) for p in parts], np.int64).tobytes()
        return block + b"".join(p.tobytes() + bytes(-p.nbytes % 8) for p in parts)

    def find(self, names: list[bytes]) -> np.ndarray:
        """The rank of each word, or -1."""
        out = np.full(len(names), -1, np.int64)
        if not len(self.keys):
            return out
        sizes = np.fromiter(map(len, names), np.int64, len(names))
        flat = np.frombuffer(b"".join(names), np.uint8)
        starts = np.cumsum(sizes) - sizes
        rows, state, total = np.arange(len(names)), np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        step = 0
        while len(rows):
            key = state << 8 | flat[starts[rows] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            rows, at = rows[hit], at[hit]
            state, total = self.target[at].astype(np.int64), total[hit] + self.number[at]
            step += 1
            ended = sizes[rows] == step
            whole = ended & (self.final[state] == 1)
            out[rows[whole]] = total[whole]
            rows, state, total = rows[~ended], state[~ended], total[~ended]
        return out


@lru_cache(maxsize=1)
def opened(block: bytes) -> Lexicon:
    """The lexicon at hand, mapped once for all tasks of a worker."""
    return Lexicon.opened(block)


def normalised(text: str, path: str) -> str:
    """As the library does it, save that white space isn't collapsed, which parts words all the same."""
    return text.lower() if text.isascii() or not NOT_PLAIN.search(text) else normaliser(path)(text)


def cut(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Normalised texts joined, their code points, and (starts, ends, text number) of their words."""
    whole = "".join(texts)
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    offsets = np.cumsum([0, *map(len, texts)])
    if not n:
        return whole, points, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = character_classes()[points]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    border[1:n] |= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    first = border[:n] & (kind != NONE)
    last = border[1:] & (kind != NONE)
    quote = np.flatnonzero((points == 0x27) & first & last)
    text_end = offsets[np.searchsorted(offsets, quote, "right")]
    padded = np.concatenate([points, np.zeros(2, np.uint32)])
    a, b = padded[quote + 1], np.where(quote + 2 < text_end, padded[quote + 2], 0)
    a = np.where(quote + 1 < text_end, a, 0)
    short = np.isin(a, [ord(c) for c in "stmd"])
    long = (a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    for some, size in ((short, 2), (long, 3)):
        at = quote[some]
        last[at], first[at + 1] = False, False
        last[at + size - 1] = True
        more = at + size
        more = more[more < text_end[some]]
        first[more[kind[more] == LETTER]] = True
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return whole, points, starts, ends, np.searchsorted(offsets, starts, "right") - 1


class Encoder:
    """Encodes batches of texts with a vocabulary and, where given, a lexicon, else a memo of words."""

    def __init__(self, v: Vocabulary, lexicon: Lexicon | None = None):
        self.v, self.lexicon = v, lexicon
        self.codes = mix(np.arange(0x110000, dtype=U)) | U(1)
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, U)
        self.known_at, self.known_size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def of_words(self, hashes: np.ndarray, name) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool of ids, start, size) of each distinct word; name(i) gives the bytes of word i."""
        if self.lexicon is not None:
            names = [name(i) for i in range(len(hashes))]
            rank = self.lexicon.find(names)
            start, size = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
            seen = rank >= 0
            start[seen] = self.lexicon.at[rank[seen]]
            size[seen] = self.lexicon.at[rank[seen] + 1] - start[seen]
            ids, count = merged(
                self.v, [names[i] for i in np.flatnonzero(~seen).tolist()]
            ) if not seen.all() else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            start[~seen], size[~seen] = len(self.lexicon.ids) + np.cumsum(count) - count, count
            return np.concatenate([self.lexicon.ids, ids]), start, size
        at = np.searchsorted(self.known, hashes)
        seen = np.zeros(len(hashes), bool)
        inside = at < len(self.known)
        seen[inside] = self.known[at[inside]] == hashes[inside]
        new = np.flatnonzero(~seen)
        if len(new) and len(self.known) + len(new) > MEMO_WORDS and len(self.known):
            self.forget()
            return self.of_words(hashes, name)
        if len(new):
            ids, count = merged(self.v, [name(i) for i in new.tolist()])
            keys = np.concatenate([self.known, hashes[new]])
            order = np.argsort(keys, kind="stable")
            starts = len(self.pool) + np.cumsum(count) - count
            self.known = keys[order]
            self.known_at = np.concatenate([self.known_at, starts])[order]
            self.known_size = np.concatenate([self.known_size, count])[order]
            self.pool = np.concatenate([self.pool, ids])
            at = np.searchsorted(self.known, hashes)
        return self.pool, self.known_at[at], self.known_size[at]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets by text)."""
        plain = [normalised(t, self.v.path) for t in texts]
        odd = {}
        if self.v.special_pattern and any("<|" in t for t in texts):
            odd = {i: t for i, t in enumerate(texts) if self.v.special_pattern.search(t)}
            for i in odd:
                plain[i] = ""
        whole, points, starts, ends, text = cut(plain)
        count = np.zeros(len(texts), np.int64)
        ids = np.zeros(0, np.int32)
        if len(starts):
            hashes, first, back = np.unique(span_hashes(self.codes[points], starts, ends), return_index=True, return_inverse=True)
            pool, at, size = self.of_words(hashes, lambda i: whole[starts[first[i]] : ends[first[i]]].encode("utf-8", "surrogatepass"))
            sizes = size[back]
            ids = pool[spread(at[back], sizes)]
            count = np.bincount(text, sizes, len(texts)).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(count)])
        if odd:
            rows = [self.with_special(odd[i]) if i in odd else ids[offsets[i] : offsets[i + 1]] for i in range(len(texts))]
            ids, offsets = np.concatenate(rows), np.cumsum([0, *map(len, rows)])
        return ids, offsets

    def with_special(self, text: str) -> np.ndarray:
        pieces, at = [], 0
        for m in self.v.special_pattern.finditer(text):
            pieces += [self.encode([text[at : m.start()]])[0], np.array([self.v.special[m[0]]], np.int32)]
            at = m.end()
        return np.concatenate([*pieces, self.encode([text[at:]])[0]])


def decode(v: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Each text's tokens joined by a space, in UTF-8: what a vocabulary without a decoder stands for."""
    sizes = v.token_at[ids + 1] - v.token_at[ids]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    data = v.token_bytes[spread(v.token_at[ids], sizes)].tobytes()
    return [data[ends[a] : max(ends[a], ends[b] - 1)] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def runs_of_texts(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of about `limit` characters, whole texts."""
    texts = strings(column).to_pylist()
    lo, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield lo, texts[lo:i]
            lo, size = i, 0
        size += len(text)
    if lo < len(texts):
        yield lo, texts[lo:]


def word_counts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """A summary of a task's frequent words: counts fall together when it holds too many."""
    codes = mix(np.arange(0x110000, dtype=U)) | U(1)
    held: dict[str, int] = {}
    for batch in batches:
        for _, texts in runs_of_texts(batch.column("text")):
            whole, points, starts, ends, _ = cut([normalised(t, path) for t in texts])
            if not len(starts):
                continue
            _, first, n = np.unique(span_hashes(codes[points], starts, ends), return_index=True, return_counts=True)
            if len(first) > SUMMARY_WORDS:
                top = np.argpartition(n, -SUMMARY_WORDS)[-SUMMARY_WORDS:]
                first, n = first[top], n[top]
            for s, e, k in zip(starts[first].tolist(), ends[first].tolist(), n.tolist(), strict=True):
                word = whole[s:e]
                held[word] = held.get(word, 0) + k
            if len(held) > 2 * SUMMARY_WORDS:
                least = sorted(held.values())[-SUMMARY_WORDS]
                held = {w: k - least + 1 for w, k in held.items() if k >= least}
    some = [(w.encode("utf-8", "surrogatepass"), k) for w, k in held.items() if len(w) <= LONG_WORD]
    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.binary()), pa.array([k for _, k in some], pa.int64())], ["word", "n"])


def frequent_words(docs: DataFrame, path: str, most: int = LEXICON_WORDS) -> list[bytes]:
    """The words with the largest summed counts, `most` at most."""
    found = docs.select("text").mapInArrow(
        lean(lambda batches: word_counts(batches, path)), "word binary, n long"
    ).groupBy("word").agg(F.sum("n").alias("n"))
    return [w for w in found.orderBy(F.desc("n"), "word").limit(most).select("word").toArrow().column(0).to_pylist()]


def encoded(docs: DataFrame, path: str | None = None, words: list[bytes] | None = None) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of their decoded text, for each row."""
    path = path or vocabulary_path()
    block = Lexicon.compiled(vocabulary(path), frequent_words(docs, path) if words is None else words)
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        encoder = Encoder(v, opened(shared.value))
        for batch in batches:
            for lo, texts in runs_of_texts(batch.column("text")):
                ids, offsets = encoder.encode(texts)
                at = offsets.tolist()
                raw = ids.astype("<u4").tobytes()
                one = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
                two = [hashlib.sha256(x).hexdigest() for x in decode(v, ids, offsets)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, len(texts)), pa.array(np.diff(offsets)), pa.array(one), pa.array(two)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
