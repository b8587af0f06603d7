"""Secret scans over a ledger of content-addressed versions.

Every version (row) of the corpus is addressed by the SHA-256 of its text.  A blob is scanned once per
rule version, however many rows hold it, and never again if a ledger of earlier scans has the pair;
findings are kept with their rule version and joined back to every row that holds the blob.

Defined cases: null text counts as empty and has no findings; null keys are keys; repeated rows, and ids that
repeat with other texts, each get their result; extra columns, whatever their names but __sha and __spans, pass
through unread; an empty table gives no rows; texts are scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import lean, saved, strings, table
from parley.sources.scratch import file_system_of

# The base kinds in the order in which equal starts are listed, then what this module adds.
BASE_KINDS = ("assign", "access", "hex")
RULES_VERSION = "rules-1.1"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
# A private key: from its BEGIN line to the END line of the same label or, where the text has none before the next BEGIN,
# over the lines of base64 that follow (and known header lines before them); the last line of a key may be short.
_GAP, _LINE = r"""(?:[\s>\#*|"',]|\\[rn])""", r"(?:(?:\\r)?\\n|\r?\n)[ \t>\#*|]*"
_HEADERS = rf"(?:{_LINE}(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID):[^\n\\]*)*"
_BASE64 = rf"(?:(?:{_GAP}*[A-Za-z0-9+/=]{{16,}})+(?:(?:{_LINE}|[ \t]+)[A-Za-z0-9+/=]+)?(?:{_LINE}=[A-Za-z0-9+/]{{4}})?|{_LINE}[A-Za-z0-9+/=]+)?"
_END = rf"(?:{_GAP}*-----END [A-Z0-9\x20]*PRIVATE KEY(?: BLOCK)?-----)?"
PEM = rf"-----BEGIN (?P<label>(?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END (?P=label)-----|{_HEADERS}{_BASE64}{_END})"
MORE = {"pem": re.compile(PEM), "github": re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")}
NEEDLES = ("passw", "secret", "token", "apikey", "api_key")
FINDINGS = "sha string, n_assign long, n_access long, n_hex long, base string, spans string"
LEDGER = "sha string, rules string"


def spans_of(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every finding, by start, then kind as listed; code points, end exclusive."""
    low = text.lower()
    found = []
    if any(x in low for x in NEEDLES):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if "PRIVATE KEY" in text or "gh" in text:
        found += [(m.start(), m.end(), kind) for kind, rule in MORE.items() for m in rule.finditer(text)]
    order = {k: i for i, k in enumerate((*BASE_KINDS, *MORE))}
    return sorted(found, key=lambda x: (x[0], order[x[2]]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each (sha, text) with findings, a row; blobs without any need none."""
    for batch in batches:
        rows = []
        for sha, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
            if spans := spans_of(text.as_py()):
                base = [x for x in spans if x[2] in BASE_KINDS]
                rows.append((sha, *(sum(x[2] == k for x in base) for k in BASE_KINDS), joined(base), joined(spans)))
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
            ["sha", "n_assign", "n_access", "n_hex", "base", "spans"]
        )


def addressed(versions: DataFrame, key: str = "doc_id") -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return versions.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.sha2(text, 256).alias("sha"), text.alias("text"))


def unseen(versions: DataFrame, ledger: DataFrame | None = None, key: str = "doc_id", rules: str = RULES_VERSION) -> DataFrame:
    """(sha, text) of each blob that the ledger (sha, rules) lacks under these rules, once (for each row of its least key)."""
    blobs = addressed(versions, key)
    owners = blobs.groupBy("sha").agg(F.min("key").alias("key"))
    if ledger is not None:
        owners = owners.join(ledger.where(F.col("rules") == rules).hint("merge"), "sha", "left_anti")
    return blobs.join(owners.hint("merge"), ["key", "sha"], "left_semi").select("sha", "text")


def scan(
    versions: DataFrame, ledger: DataFrame | None = None, known: DataFrame | None = None, key: str = "doc_id",
    rules: str = RULES_VERSION
) -> DataFrame:
    """Findings under these rules: of blobs scanned now and, with a ledger, those `known` under the same rules from before.

    One row per blob with findings: sha, counts of the base kinds, base and all spans, rules.
    """
    found = unseen(versions, ledger, key, rules).mapInArrow(lean(scan_batches), FINDINGS).dropDuplicates(["sha"]).withColumn("rules", F.lit(rules))
    return found if known is None else found.unionByName(known.where(F.col("rules") == rules))


def ledger_of(versions: DataFrame, key: str = "doc_id", rules: str = RULES_VERSION) -> DataFrame:
    """The (sha, rules) pairs that a scan of these versions settles, for the next run's ledger."""
    return addressed(versions, key).select("sha").distinct().withColumn("rules", F.lit(rules))


def incremental(versions: DataFrame, folder: str, key: str = "doc_id", rules: str = RULES_VERSION) -> DataFrame:
    """Findings of all versions; the folder's ledger and findings spare blobs that it has, and grow by the others.

    Findings are written before the pairs that settle them, so a run that is cut short is only done again.
    """
    spark = versions.sparkSession
    rows = saved(addressed(versions, key).select("key", "sha"))
    ledger, known = (_table_at(spark, f"{folder}/{name}", kind) for name, kind in (("ledger", LEDGER), ("findings", f"{FINDINGS}, rules string")))
    fresh = saved(scan(versions, ledger, None, key, rules))
    fresh.join(known.select("sha", "rules"), ["sha", "rules"], "left_anti").write.mode("append").parquet(f"{folder}/findings")
    done = rows.select("sha").distinct().withColumn("rules", F.lit(rules)).join(ledger.hint("merge"), ["sha", "rules"], "left_anti")
    saved(done).write.mode("append").parquet(f"{folder}/ledger")
    findings = _table_at(spark, f"{folder}/findings", f"{FINDINGS}, rules string").where(F.col("rules") == rules)
    return rows.join(findings, "sha")


def _table_at(spark, path: str, kind: str) -> DataFrame:
    file_system, at = file_system_of(spark, path)
    return spark.read.schema(kind).parquet(path) if file_system.exists(at) else spark.createDataFrame([], kind)


def redacted(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """The rows with every finding's span replaced in text and n_chars (where there is one) counted anew."""
    names = docs.columns
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    found = scan(docs).select("sha", "spans")
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    marked = docs.withColumn("__sha", sha).join(found.withColumnsRenamed({"sha": "__sha", "spans": "__spans"}), "__sha", "left")

    def clean(text: str, spans: str) -> str:
        out, end = [], 0
        for start, stop in (tuple(map(int, x.split(":")[1:])) for x in spans.split(",")):
            if start >= end:
                out += [text[end:start], mask]
            end = max(end, stop)
        return "".join([*out, text[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, spans = list(batch.columns[:-1]), batch.columns[-1].to_pylist()
            if any(spans):
                texts = columns[at].to_pylist()
                for i, s in enumerate(spans):
                    if s:
                        texts[i] = clean(texts[i], s)
                if chars is not None:
                    sizes = columns[chars].to_pylist()
                    sizes = [len(t) if s else n for t, s, n in zip(texts, spans, sizes, strict=True)]
                    columns[chars] = pa.array(sizes, columns[chars].type)
                columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return marked.select(*(F.col(f"`{n}`") for n in names), "__spans").mapInArrow(lean(run), docs.schema)


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    out = rows.join(scan(docs), "sha", "left")
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select(
        "doc_id", *map(count, ("n_assign", "n_access", "n_hex")), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans")
    )
