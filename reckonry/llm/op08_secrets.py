"""Secret spans: three fixed patterns, and strings that a primed zstandard can't foretell.

A candidate is a long run of key characters with letters and digits that follows a sensitive word.
What it costs is measured: the text around it, less other copies of the candidate, is compressed
with and without it, by a compressor primed with a dictionary of code and identifiers. The bytes that
the candidate adds, as a share of its length, are its novelty; names made of known words cost
less, random keys nearly all their length, however often they are printed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from reckonry.llm.batches import slices

KINDS = ("assign", "access", "hex", "novel")
#: Fixed by the task.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run of 24 or more is what [0-9a-f]+ leaves when shorter ones drop
ASSIGNED, ACCESS_LENGTH = 6, 20

ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
SENSITIVE = re.compile(r"password|passwd|passphrase|secret|token|key|credential|bearer|auth|private|signature", re.I | re.A)
SENSITIVE_WORDS = ("passw", "passphrase", "secret", "token", "key", "credential", "bearer", "auth", "private", "signature")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
BEFORE, AROUND, NOVELTY = 64, 512, 0.6

IDENTIFIERS = """
import from return class function const static final public private protected void string int long bool true false null none
self this new def var let async await export default module require package include namespace struct enum interface
config settings environment process database connection username password secret token api_key access_key client_id client_secret
authorization bearer header request response session cookie user account email address server host port path url http https www com
org net localhost index version build release debug info warning error message value name type size length count total number data
file folder input output buffer encode decode base64 utf-8 json yaml xml html css select insert update delete where group order
0123456789 abcdef ABCDEF 2020-01-01 2024-12-31T00:00:00Z 127.0.0.1 00000000-0000-0000-0000-000000000000 ffffffffffffffff
-----BEGIN PRIVATE KEY----- -----END PRIVATE KEY----- application/json Content-Type X-Api-Key getElementById setTimeout
""".split()


def compressor() -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(" ".join(IDENTIFIERS).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)


def _without(text: str, low: int, high: int, own: str, limit: int) -> str:
    """``text[low:high]`` less the occurrences of ``own``, those cut by its ends too; none is sought beyond ``limit``."""
    kept, at = [], low
    until = min(limit, high + len(own) - 1)
    found = text.find(own, max(0, low - len(own) + 1), until)
    while found >= 0:
        kept.append(text[at:max(at, found)])
        at = found + len(own)
        found = text.find(own, at, until)
    return "".join(kept) + text[at:high]


def novelty(packer: zstandard.ZstdCompressor, text: str, start: int, end: int) -> float:
    """Bytes that the string adds to its compressed surroundings without its copies, as a share of its length."""
    own = text[start:end]
    left, right = _without(text, max(0, start - AROUND), start, own, start), _without(text, end, min(len(text), end + AROUND), own, len(text))
    without = len(packer.compress((left + right).encode("utf-8", "replace")))
    whole = len(packer.compress((left + right + text[start:end]).encode("utf-8", "replace")))
    return (whole - without) / max(1, end - start)


def base_spans(text: str, low: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, each kind leftmost without overlaps."""
    spans = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if any(w in low for w in ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGNED]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    return sorted(spans)


def novel_spans(packer: zstandard.ZstdCompressor, text: str, low: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of incompressible strings after a sensitive word, beside the base spans."""
    if not any(w in low for w in SENSITIVE_WORDS):
        return []
    out, others = [], []
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        own = m[0]
        if not (any(c.isdigit() for c in own) and any(c.isalpha() for c in own)) or any(a < end and start < b for a, _, b in base):
            continue
        if SENSITIVE.search(text, max(0, start - BEFORE), start):
            (out if novelty(packer, text, start, end) >= NOVELTY else others).append((start, 3, end))
    novel = {text[a:b] for a, _, b in out}
    # a longer run around a novel string is foretold by that string
    return out + [(a, k, b) for a, k, b in others if any(x in text[a:b] for x in novel)]


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each stretch that spans cover replaced by ``mark``."""
    out, at = [], 0
    for start, _, end in sorted(spans):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join(out) + text[at:]


def spans_of(packer: zstandard.ZstdCompressor, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans."""
    low = text.lower()
    base = base_spans(text, low)
    return base, base + novel_spans(packer, text, low, base)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row.

    Offsets are code points of the whole text, ends exclusive. A null text counts as empty: no spans
    and the digest of an empty string. Rows are judged one by one, so repeats, null ids and other
    columns don't matter.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = compressor()
        for batch in batches:
            for part in slices(batch):
                rows = []
                for text in part.column("text").to_pylist():
                    base, spans = spans_of(packer, text or "")
                    kinds = [k for _, k, _ in base]
                    rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(_written(base).encode()).hexdigest(), _written(spans)))
                columns = list(zip(*rows))
                arrays = [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted_rows(docs: DataFrame) -> DataFrame:
    """All rows of ``docs`` with secrets in text replaced and n_chars, if there, set to the new length; null texts stay null."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = compressor()
        for batch in batches:
            for part in slices(batch):
                texts, names = part.column("text").to_pylist(), part.schema.names
                found = {i: spans for i, text in enumerate(texts) if text and (spans := spans_of(packer, text)[1])}
                if found:
                    lengths = part.column("n_chars").to_pylist() if "n_chars" in names else None
                    for i, spans in found.items():
                        texts[i] = redacted(texts[i], spans)
                        if lengths:
                            lengths[i] = len(texts[i])
                    part = part.set_column(names.index("text"), part.schema.field("text"), pa.array(texts, part.schema.field("text").type))
                    if lengths:
                        part = part.set_column(names.index("n_chars"), part.schema.field("n_chars"), pa.array(lengths, part.schema.field("n_chars").type))
                yield part

    return docs.mapInArrow(work, docs.schema)


def op8_secret_novelty(spark: SparkSession, folder: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{folder}/documents.parquet"))


QUERY = op8_secret_novelty
SQL = None
