"""Quality rules as a short-circuit cascade.

Each rule rejects texts by measures of the whole text. A bounded sample tells what each rule costs
and what share of the texts still alive it rejects; rules then run in the order of rejection per
cost, each only on what the ones before it let through. A text is kept if no rule rejects it, so the
order changes the cost and never the result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from reckonry.llm.batches import slices
from reckonry.llm.words import SPACE, Words, shingles_of, words_of

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
WINDOW = 5
#: Bytes of text that a task works on at once, with some twenty times as much beside them.
BATCH = 1 << 20
SAMPLE_ROWS, SAMPLE_BYTES = 200, 1 << 18


def _sum_in(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set between each two offsets, the last of which is the number of flags."""
    out, full = np.zeros(len(offsets) - 1, np.int64), np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(flags, offsets[full], dtype=np.int64)
    return out


@dataclass
class Texts:
    """Whole texts of a batch; a measure is worked out when first asked for, and then kept."""

    texts: pa.Array
    known: dict[str, np.ndarray] = field(default_factory=dict)
    _words: Words | None = None

    @property
    def words(self) -> Words:
        self._words = self._words or words_of(self.texts)
        return self._words

    def __len__(self) -> int:
        return len(self.texts)

    def of(self, measure: str) -> np.ndarray:
        if measure not in self.known:
            self.known[measure] = MEASURES[measure](self)
        return self.known[measure]

    def only(self, rows: np.ndarray) -> "Texts":
        return Texts(self.texts.take(pa.array(rows)), {k: v[rows] for k, v in self.known.items()})


def _word_chars(t: Texts) -> np.ndarray:
    begins = (t.words.data & 0xC0) != 0x80  # the first byte of each code point
    return _sum_in(begins & ~SPACE[t.words.data], t.words.offsets)


def _lines(t: Texts) -> np.ndarray:
    """Lines that hold a word, and those of them that equal an earlier one."""
    out = np.zeros((len(t), 2), np.int64)
    for i, text in enumerate(t.texts.to_pylist()):
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
        out[i] = len(lines), len(lines) - len(set(lines))
    return out


def _repeat_words(t: Texts) -> np.ndarray:
    first = t.words.first
    hashes, begin = shingles_of(t.words.hashes(lower=False), first, WINDOW)
    out = np.zeros(len(t), np.int64)
    for i in np.flatnonzero(t.words.counts > WINDOW):
        own = hashes[begin[i]:begin[i + 1]]
        _, at, times = np.unique(own, return_inverse=True, return_counts=True)
        again = np.flatnonzero(times[at] > 1)
        if len(again):
            change = np.zeros(first[i + 1] - first[i] + 1, np.int64)
            np.add.at(change, again, 1)
            np.add.at(change, again + WINDOW, -1)
            out[i] = (np.cumsum(change)[:-1] > 0).sum()
    return out


MEASURES: dict[str, Callable[[Texts], np.ndarray]] = {
    "n_words": lambda t: t.words.counts.astype(np.int64),
    "word_chars": _word_chars,
    "n_symbols": lambda t: _sum_in(_SYMBOL[t.words.data], t.words.offsets),
    "lines": _lines,
    "n_lines": lambda t: t.of("lines")[:, 0],
    "n_dup_lines": lambda t: t.of("lines")[:, 1],
    "n_repeat_words": _repeat_words,
}


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Texts], np.ndarray]


BASE = (
    Rule("few_words", lambda t: t.of("n_words") < 10),
    Rule("repeats", lambda t: 100 * t.of("n_repeat_words") > 20 * t.of("n_words")),
)
MORE = (
    Rule("symbols", lambda t: 5 * t.of("n_symbols") > t.of("n_words")),
    Rule("repeated_lines", lambda t: 10 * t.of("n_dup_lines") > 4 * t.of("n_lines")),
    Rule("short_words", lambda t: t.of("word_chars") < 2 * t.of("n_words")),
    Rule("long_words", lambda t: t.of("word_chars") > 20 * t.of("n_words")),
)
RULES = BASE + MORE


def _timed(rule: Rule, texts: pa.Array) -> tuple[float, np.ndarray]:
    best = np.inf
    for _ in range(3):
        fresh, begun = Texts(texts), time.perf_counter()
        rejected = rule.rejects(fresh)
        best = min(best, time.perf_counter() - begun)
    return best, rejected


def best_order(texts: pa.Array, rules: tuple[Rule, ...]) -> list[tuple[str, float, float]]:
    """(rule, seconds a text, share rejected) by rejection per cost, each among what is still alive."""
    out, left = [], list(rules)
    while left:
        measured = [(rule, *_timed(rule, texts)) for rule in left]
        rule, cost, rejected = max(measured, key=lambda m: (m[2].mean() / max(m[1], 1e-9) if len(texts) else 0, -left.index(m[0])))
        out.append((rule.name, cost / max(len(texts), 1), float(rejected.mean()) if len(texts) else 0.0))
        left.remove(rule)
        texts = texts.filter(pa.array(~rejected))
    return out


def plan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """The rules' order, measured on the first ``sample_rows`` texts of at most ``SAMPLE_BYTES`` each.

    Both bounds hold the sample small wherever it is measured; it is taken from as few partitions as it
    needs, and decides nothing but the order.
    """
    rows = docs.select("text").where(F.octet_length("text") <= SAMPLE_BYTES).take(sample_rows)
    return [name for name, _, _ in best_order(pa.array([r["text"] for r in rows], pa.large_string()), rules)]


def cascade(texts: Texts, order: list[str], rules: tuple[Rule, ...]) -> np.ndarray:
    """Which texts no rule rejects; each rule sees only what is still alive."""
    by_name, alive = {r.name: r for r in rules}, np.arange(len(texts))
    for name in order:
        rejected = by_name[name].rejects(texts)
        if rejected.any():
            alive, texts = alive[~rejected], texts.only(np.flatnonzero(~rejected))
    return alive


def judge(docs: DataFrame, measures: tuple[str, ...] = (), rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the ``measures`` asked for, and kept, for every row.

    A null text counts as an empty one, which has no words and is rejected. Repeated rows, null ids
    and other columns don't matter: each row is judged by its own text alone.
    """
    order = plan(docs, rules, sample_rows)
    names = list(measures)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, BATCH):
                texts = Texts(part.column("text"))
                columns = [pa.array(texts.of(m), pa.int64()) for m in names]
                kept = np.zeros(len(texts), bool)
                kept[cascade(texts, order, rules)] = True
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns, pa.array(kept)], ["doc_id", *names, "kept"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        work, "doc_id long, " + "".join(f"{m} long, " for m in names) + "kept boolean")


def keep(batches: Iterator[pa.RecordBatch], order: list[str], rules: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    """The rows that no rule rejects, from ``BATCH`` bytes of text at a time."""
    for batch in batches:
        for part in slices(batch, BATCH):
            yield part.take(pa.array(cascade(Texts(part.column("text")), order, rules)))


def kept_rows(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text no rule rejects."""
    order = plan(docs, rules, sample_rows)
    return docs.mapInArrow(lambda batches: keep(batches, order, rules), docs.schema)


def op4_quality_cascade(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = judge(docs, ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return found.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))


QUERY = op4_quality_cascade
SQL = r"""
with d as (
  select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) l from documents
), g as (
  select doc_id, unnest(range(1, len(w) - 3)) i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) g from d where len(w) > 4
), again as (select doc_id, g from g group by all having count(*) > 1
), r as (
  select doc_id, count(distinct p) n from (select g.doc_id, unnest(range(g.i, g.i + 5)) p from g join again a on a.doc_id = g.doc_id and a.g = g.g) group by 1
), m as (
  select d.doc_id, len(w)::bigint n_words, coalesce(len(array_to_string(w, '')), 0)::bigint word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint n_symbols, (len(l) - len(list_distinct(l)))::bigint n_dup_lines, len(l) n_lines,
    coalesce(r.n, 0)::bigint n_repeat_words from d left join r on r.doc_id = d.doc_id
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words or 5 * n_symbols > n_words or 10 * n_dup_lines > 4 * n_lines
    or word_chars < 2 * n_words or word_chars > 20 * n_words) as kept
from m
"""
