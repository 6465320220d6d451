"""Token ids in binary files under a Re-Pair grammar, one grammar per block, with random access.

Documents are dealt out by ranges of doc_id, so shard i holds the ids before shard i + 1's. A shard
is a run of blocks of whole documents, about ``BLOCK`` ids each. In a block, id pairs that are
frequent become nonterminals again and again; the block stores the rules (two symbols each), how many
ids each rule expands to, the symbols left, and where its documents begin. The lengths give the
symbol that holds any position, so a document is decoded without the rest of its block.

Files are Parquet with binary columns, written and committed by Spark in the shared folder.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from reckonry.llm.batches import slices
from reckonry.llm.words import Words, words_of
from reckonry.plans.staging import stage

BLOCK, LEAST, CACHED = 1 << 20, 12, 1_500_000
SYMBOLS = 1 << 16
MARK = "\x01"
#: Texts on which a tokenizer must do as :class:`Encoder` says.
PROBES = ("One TWO three", "  lead\tand\ntrail ", "end. Next, word,", "a.b,c d.. e,, .f", "Ünï CÖDÉ, straße.", "x1, 2.5 3, 'q.' (z).", "\x0b\x0c\r mixed\r\nlines.\n")


# ---- grammar ---------------------------------------------------------------------------------

def compress(ids: np.ndarray, base: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(rules, symbols): ids below ``base`` are themselves, ``base + i`` is the pair ``rules[i]``.

    Each round takes the pairs found ``least`` times or more, most frequent first as far as 16-bit
    symbols last, and replaces them from left to right without overlaps. Rounds go on until no pair is that frequent or
    every symbol is taken. Ids that 16 bits can't hold raise.
    """
    if base > SYMBOLS or len(ids) and int(ids.max()) >= base:
        raise ValueError(f"ids of a vocabulary of {base} do not fit symbols of 16 bits")
    symbols, rules = ids.astype(np.uint16), np.empty((0, 2), np.uint16)
    while True:
        room = SYMBOLS - base - len(rules)
        if len(symbols) < 2 or room <= 0:
            break
        pairs = symbols[:-1].astype(np.uint32) << np.uint32(16) | symbols[1:]
        ordered = np.sort(pairs)
        cuts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        times = np.diff(np.append(cuts, len(ordered)))
        often = np.flatnonzero(times >= least)
        if not len(often):
            break
        often = often[np.argsort(-times[often], kind="stable")][:max(1, min(room, 4096))]
        chosen = np.sort(ordered[cuts[often]])
        maybe = np.zeros(SYMBOLS, bool)  # a first sieve, so that few pairs are looked up
        maybe[_slot(chosen)] = True
        at = np.flatnonzero(maybe[_slot(pairs)])
        place = np.minimum(np.searchsorted(chosen, pairs[at]), len(chosen) - 1)
        hit = chosen[place] == pairs[at]
        at, place = at[hit], place[hit]
        if not len(at):
            break
        # of neighbours that overlap, every other one from the left
        breaks = np.flatnonzero(np.concatenate(([True], np.diff(at) != 1)))
        rank = np.arange(len(at)) - np.repeat(breaks, np.diff(np.append(breaks, len(at))))
        at, place = at[rank % 2 == 0], place[rank % 2 == 0]
        symbols = symbols.copy()
        symbols[at] = (base + len(rules) + place).astype(np.uint16)
        left = np.ones(len(symbols), bool)
        left[at + 1] = False
        symbols = symbols[left]
        rules = np.concatenate((rules, np.stack((chosen >> np.uint32(16), chosen & np.uint32(0xFFFF)), 1).astype(np.uint16)))
    return rules, symbols


def _slot(pairs: np.ndarray) -> np.ndarray:
    return (pairs * np.uint32(0x9E3779B1)) >> np.uint32(16)


def expansions(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids that each rule stands for; a rule's parts come before it."""
    out = np.ones(base + len(rules), np.int64)
    pairs = rules.astype(np.int64)
    known = np.zeros(base + len(rules), bool)
    known[:base] = True
    while not known.all():
        ready = ~known[base:] & known[pairs[:, 0]] & known[pairs[:, 1]]
        now = np.flatnonzero(ready)
        out[base + now] = out[pairs[now, 0]] + out[pairs[now, 1]]
        known[base + now] = True
    return out[base:]


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that ``symbols`` stand for."""
    symbols = symbols.astype(np.uint16)
    while True:
        at = np.flatnonzero(symbols >= base)
        if not len(at):
            return symbols.astype(np.uint32)
        pairs = rules[symbols[at].astype(np.int64) - base]
        wide = np.ones(len(symbols), np.int64)
        wide[at] = 2
        symbols = np.repeat(symbols, wide)
        first = at + np.arange(len(at))
        symbols[first], symbols[first + 1] = pairs[:, 0], pairs[:, 1]


@dataclass(frozen=True)
class Block:
    """A block as stored: ``base``, rules, their expansion lengths, symbols."""

    base: int
    rules: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray

    @classmethod
    def read(cls, base: int, rules: bytes, lengths: bytes, symbols: bytes) -> "Block":
        return cls(base, np.frombuffer(rules, "<u2").reshape(-1, 2), np.frombuffer(lengths, "<u4"), np.frombuffer(symbols, "<u2"))

    def all(self) -> np.ndarray:
        return expand(self.symbols, self.rules, self.base)

    def part(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop``, decoding only the symbols that hold them."""
        sizes = np.concatenate((np.ones(self.base, np.int64), self.lengths))[self.symbols]
        ends = np.cumsum(sizes)
        first = int(np.searchsorted(ends, start, "right"))
        last = int(np.searchsorted(ends, stop, "left")) + 1
        skipped = int(ends[first - 1]) if first else 0
        return expand(self.symbols[first:last], self.rules, self.base)[start - skipped:stop - skipped]


# ---- ids -------------------------------------------------------------------------------------

class Encoder:
    """Ids of whole texts by the tokenizer, each distinct word once.

    The tokenizer drops white space, reads capitals as small letters and parts letters from the comma
    or full stop after them, and looks at nothing beyond; so a text's ids are those of its words, one
    after another, with such an end as a word of its own.
    """

    def __init__(self, vocabulary: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_str(vocabulary), end_id
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self._forget()
        if self.tokenizer.get_vocab_size(with_added_tokens=True) > SYMBOLS:
            raise ValueError("token files hold ids of 16 bits; this vocabulary has more")
        found, begin = self.encode(pa.array(PROBES))
        for text, a, b in zip(PROBES, begin[:-1].tolist(), begin[1:].tolist()):
            if found[a:b - 1].tolist() != self.tokenizer.encode(text, add_special_tokens=False).ids:
                raise ValueError(f"this tokenizer does not read a text word by word: {text!r}")

    def _forget(self) -> None:
        """Known words: sorted hashes, each with its place in ``bounds``; their ids one after another."""
        self.hashes, self.places = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.flat, self.bounds = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Encode new words in one go, parted by a mark that is a word with an id of its own."""
        odd = [i for i, w in enumerate(words) if MARK in w]
        plain = [w if MARK not in w else "" for w in words] if odd else words
        found = np.array(self.tokenizer.encode_batch_fast([f" {MARK} ".join(plain)], add_special_tokens=False)[0].ids, np.uint32)
        marks = np.flatnonzero(found == self.mark)
        ends = np.append(marks - np.arange(len(marks)), len(found) - len(marks))
        flat = found[found != self.mark]
        for i in odd:  # the mark itself in a text
            own = np.array(self.tokenizer.encode(words[i], add_special_tokens=False).ids, np.uint32)
            flat = np.insert(flat, ends[i], own)
            ends[i:] += len(own)
        self.places = np.concatenate((self.places, np.arange(len(words), dtype=np.int32) + len(self.bounds) - 1))
        self.bounds = np.concatenate((self.bounds, ends + len(self.flat)))
        self.flat = np.concatenate((self.flat, flat))
        self.hashes = np.concatenate((self.hashes, hashes))
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.places = self.hashes[order], self.places[order]

    def _known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        return (self.hashes[at] == hashes, at) if len(self.hashes) else (np.zeros(len(hashes), bool), at)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each followed by the end id, and where each text's begin."""
        words = _without_ends(words_of(texts))
        data = words.data.tobytes()
        # special tokens are told by their case
        distinct, first, inverse = np.unique(words.hashes(lower=b"<|" not in data), return_index=True, return_inverse=True)
        if len(self.hashes) + len(distinct) > CACHED:
            self._forget()
        known, at = self._known(distinct)
        if not known.all():
            new = first[~known]
            self._learn(distinct[~known], [data[a:b].decode() for a, b in zip(words.starts[new].tolist(), words.ends[new].tolist())])
            at = self._known(distinct)[1]
        place = self.places[at]
        begin, size = self.bounds[place][inverse], (self.bounds[place + 1] - self.bounds[place])[inverse]
        before = np.concatenate(([0], np.cumsum(size)))
        shift = begin - before[:-1]
        found = self.flat[np.arange(int(before[-1])) + np.repeat(shift, size)]
        starts = before[words.first]
        out = np.insert(found, starts[1:], np.uint32(self.end_id)) if len(texts) else found
        return out, starts + np.arange(len(texts) + 1)


@lru_cache(1)
def encoder_of(vocabulary: str, end_id: int) -> Encoder:
    """The encoder of a worker, which keeps the words it has learned for the worker's later tasks."""
    return Encoder(vocabulary, end_id)


def _without_ends(words: Words) -> Words:
    """Words with a comma or full stop right after an ASCII letter as a word of its own."""
    data, last = words.data, words.ends - 1
    letter = (data | 0x20) - 97 < 26  # bytes wrap around
    cut = (words.ends - words.starts > 1) & ((data[last] == 0x2C) | (data[last] == 0x2E)) & letter[last - 1]
    at = np.flatnonzero(cut)
    own = last[at]
    starts, ends = np.insert(words.starts, at + 1, own), np.insert(np.where(cut, last, words.ends), at + 1, own + 1)
    first = words.first + np.concatenate(([0], np.cumsum(cut)))[words.first]
    return Words(data, words.offsets, starts, ends, first)


FILE_SCHEMA = ("shard int, block int, first long, n_tokens long, base int, doc_ids array<long>, starts array<long>, "
               "rules binary, lengths binary, symbols binary")


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int = 2, block: int = BLOCK) -> DataFrame:
    """Encode every whole text and write the blocks; returns the files as read back.

    A null text counts as empty: its only id is the end id. Null ids come first, rows that share an
    id follow in the order of their texts' hashes. Other columns are not read. ``vocabulary`` is the
    tokenizer's description, a bounded text that travels with the job.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shipped.value, end_id)
        base = encoder.tokenizer.get_vocab_size(with_added_tokens=True)
        shard, number, first = TaskContext.get().partitionId(), 0, 0
        ids, starts, pieces, held = [], [], [], 0
        for batch in batches:
            for part in slices(batch, 2 << 20):
                found, begin = encoder.encode(part.column("text"))
                ids += part.column("doc_id").to_pylist()
                starts.append(begin[:-1] + held)
                pieces.append(found)
                held += len(found)
                if held >= block:
                    yield _written(shard, number, first, base, ids, starts, pieces)
                    number, first = number + 1, first + held
                    ids, starts, pieces, held = [], [], [], 0
        if held:
            yield _written(shard, number, first, base, ids, starts, pieces)

    placed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie")).repartitionByRange("doc_id", "tie")
    files = placed.sortWithinPartitions("doc_id", "tie").select("doc_id", "text").mapInArrow(work, FILE_SCHEMA)
    return stage(files, "token-files")


def _written(shard, number, first, base, ids, starts, pieces) -> pa.RecordBatch:
    tokens = np.concatenate(pieces)
    rules, symbols = compress(tokens, base)
    row = [[shard], [number], [first], [len(tokens)], [base], [ids], [np.concatenate(starts)], [rules.astype("<u2").tobytes()],
           [expansions(rules, base).astype("<u4").tobytes()], [symbols.astype("<u2").tobytes()]]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)],
                                      [x.split()[0] for x in FILE_SCHEMA.split(", ")])


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    per_shard = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # one row a shard
    before = per_shard.select("shard", F.coalesce(F.sum("n").over(
        Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shard_start"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                block = Block.read(row["base"].as_py(), *(row[x].as_buffer() for x in ("rules", "lengths", "symbols")))
                ids = memoryview(block.all().astype("<u4")).cast("B")
                starts = row["starts"].values.to_numpy()
                ends = np.append(starts[1:], row["n_tokens"].as_py())
                crcs = [zlib.crc32(ids[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                offset = row["shard_start"].as_py() + row["first"].as_py()
                yield pa.RecordBatch.from_arrays(
                    [row["doc_ids"].values, pa.array(starts + offset), pa.array(ends - starts), pa.array(crcs, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.join(before, "shard").drop("block").mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_repair_token_files(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        vocabulary = file.read()
    return read_token_files(write_token_files(spark.read.parquet(f"{folder}/documents.parquet"), vocabulary))


QUERY = op9_repair_token_files
SQL = None
