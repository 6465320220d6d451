"""Encoding to and from the pieces of a SentencePiece vocabulary by unigram Viterbi.

The vocabulary's pieces and scores stand in a double-array trie over UTF-8 bytes. A text gets a
leading white-space mark, its spaces become marks, and the sequence of pieces with the largest sum of
scores is taken; of equal sums, the one whose last piece is longest. A character that is no piece
costs ``UNKNOWN`` less than the worst piece and comes out as its bytes' pieces. Decoding joins the
pieces, reads marks as spaces and drops the leading one.

As no piece goes on past a mark or a character that no piece holds, a text falls into stretches that
are solved one by one, and a stretch seen before is not solved again. Any text is done whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from reckonry.llm.batches import slices

MARK, UNKNOWN, CACHED = "▁", 10.0, 200_000


@dataclass(frozen=True)
class Trie:
    """Arrays of a double-array trie: from state s, byte c leads to ``base[s] + c + 1`` if ``check`` there is s."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray  # the key's number, or -1

    @classmethod
    def build(cls, keys: list[bytes], numbers: list[int]) -> "Trie":
        nodes: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for key, number in zip(keys, numbers):
            at = 0
            for c in key:
                at = nodes[at].setdefault(c, len(nodes))
                if at == len(nodes):
                    nodes.append({})
            ends[at] = number
        size = len(nodes) * 2 + 512
        base, check, value, used = [0] * size, [-1] * size, [-1] * size, bytearray(size)
        used[0], check[0] = 1, 0
        todo, free = [(0, 0)], 1
        while todo:
            node, state = todo.pop()
            if node in ends:
                value[state] = ends[node]
            codes = sorted(nodes[node])
            if not codes:
                continue
            slot = max(free, codes[0] + 1)  # from about where the last one fitted: dense parts aren't searched again
            while True:
                start = slot - codes[0] - 1
                if start + 258 >= len(used):
                    grow = len(used)
                    base += [0] * grow
                    check += [-1] * grow
                    value += [-1] * grow
                    used += bytes(grow)
                if not any(used[start + c + 1] for c in codes):
                    break
                slot += 1
            base[state], free = start, max(free, slot - 300)
            for c in codes:
                used[start + c + 1], check[start + c + 1] = 1, state
                todo.append((nodes[node][c], start + c + 1))
        last = len(used) - used[::-1].index(1) + 258
        return cls(*(np.array(x[:last], np.int32) for x in (base, check, value)))


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id, with scores; kinds: n normal, b byte, o other."""

    pieces: list[str]
    scores: list[float]
    kinds: str
    trie: Trie

    @classmethod
    def read(cls, path: str) -> "Vocabulary":
        """From a SentencePiece model file."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        pieces, scores = [model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids]
        kinds = "".join("b" if model.is_byte(i) else "o" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "n" for i in ids)
        return cls.of(pieces, scores, kinds)

    @classmethod
    def of(cls, pieces: list[str], scores: list[float], kinds: str) -> "Vocabulary":
        normal = [i for i, k in enumerate(kinds) if k == "n"]
        return cls(pieces, scores, kinds, Trie.build([pieces[i].encode() for i in normal], normal))


class Coder:
    """Encodes and decodes whole texts; lives in a task."""

    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        self.base, self.check, self.value = (x.tolist() for x in (v.trie.base, v.trie.check, v.trie.value))
        self.scores = v.scores
        normal = [i for i, k in enumerate(v.kinds) if k == "n"]
        self.unknown = min((v.scores[i] for i in normal), default=0.0) - UNKNOWN
        self.byte_ids = {int(v.pieces[i][3:5], 16): i for i, k in enumerate(v.kinds) if k == "b"}
        self.unknown_id = next((i for i, p in enumerate(v.pieces) if v.kinds[i] == "o" and p == "<unk>"), 0)
        self.is_byte = np.array([k == "b" for k in v.kinds])
        self.bytes_of = [bytes([int(p[3:5], 16)]) if k == "b" else p.encode() if k == "n" else b"" for p, k in zip(v.pieces, v.kinds)]
        held = {c for i in normal for c in v.pieces[i]}
        alone = "".join(c for c in "\n\t\r" if c not in held)  # no piece holds these, so they part stretches
        inner = any(MARK in v.pieces[i].lstrip(MARK) for i in normal)
        self.stretch = re.compile(r"(?s).+" if inner else f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]" if alone else ""))
        self.known: dict[str, tuple[int, ...]] = {}

    def solve(self, stretch: str) -> tuple[int, ...]:
        """The best pieces of one stretch."""
        data = stretch.encode()
        size = len(data)
        best: list[float | None] = [None] * (size + 1)
        back: list[tuple[int, int]] = [(0, 0)] * (size + 1)
        best[0] = 0.0
        base, check, value, scores = self.base, self.check, self.value, self.scores
        at = 0
        while at < size:
            lead = data[at]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            here, state, j, single = best[at], 0, at, False
            while j < size:
                to = base[state] + data[j] + 1
                if check[to] != state:
                    break
                state, j = to, j + 1
                number = value[state]
                if number >= 0:
                    total = here + scores[number]
                    if best[j] is None or total > best[j]:
                        best[j], back[j] = total, (at, number)
                    single = single or j == at + width
            if not single:
                total, j = here + self.unknown, at + width
                if best[j] is None or total > best[j]:
                    best[j], back[j] = total, (at, -1)
            at += width
        out: list[int] = []
        while at:
            start, number = back[at]
            if number >= 0:
                out.append(number)
            else:
                out += [self.byte_ids.get(c, self.unknown_id) for c in reversed(data[start:at])] if self.byte_ids else [self.unknown_id]
            at = start
        return tuple(reversed(out))

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        known, out = self.known, []
        for stretch in self.stretch.findall(MARK + text.replace(" ", MARK)):
            found = known.get(stretch)
            if found is None:
                found = self.solve(stretch)
                if len(stretch) <= 64:
                    if len(known) >= CACHED:
                        known.clear()
                    known[stretch] = found
            out += found
        return out

    def decode(self, ids: list[int]) -> str:
        text = b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def _encoded(coder: Coder, texts: list[str | None]) -> tuple[list[pa.Array], list[str]]:
    """ids, n_pieces, n_byte_pieces, same of each text."""
    flat, ends, fallback, same, total = [], [0], [], [], 0
    for text in texts:
        ids = coder.encode(text or "")
        flat.append(np.array(ids, np.int32))
        total += len(ids)
        ends.append(total)
        fallback.append(int(coder.is_byte[flat[-1]].sum()))
        same.append(text is None or coder.decode(ids) == text)
    offsets = pa.array(ends, pa.int32(), mask=np.array([t is None for t in texts] + [False]))
    return [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(flat))), pa.array(np.diff(ends), pa.int64()),
            pa.array(fallback, pa.int64()), pa.array(same, pa.bool_())], ["ids", "n_pieces", "n_byte_pieces", "same"]


def encode_column(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``docs`` with ids, n_pieces, n_byte_pieces and same added in place of text (columns of these names are replaced).

    same tells whether decoding gives the text again. A null text has null ids and no pieces; an empty
    one has none. Texts that hold the mark itself come back with a space for it. Rows are judged one by
    one. The vocabulary is bounded and travels with the job.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)
    docs = docs.drop("ids", "n_pieces", "n_byte_pieces", "same")
    others = [f for f in docs.schema.fields if f.name != "text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shipped.value)
        for batch in batches:
            for part in slices(batch, 4 << 20):
                arrays, names = _encoded(coder, part.column("text").to_pylist())
                kept = [n for n in part.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([part.column(n) for n in kept] + arrays, kept + names)

    schema = StructType([*others, *StructType.fromDDL("ids array<int>, n_pieces long, n_byte_pieces long, same boolean").fields])
    return docs.mapInArrow(work, schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and the text that ``ids`` stand for; null ids give a null text."""
    shipped = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shipped.value)
        for batch in batches:
            texts = [None if ids is None else coder.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, text string")


def public_vocabulary() -> Vocabulary:
    import public_tokenizers

    return Vocabulary.read(public_tokenizers.path("piece_bpe_32k.model"))


def op1_unigram_pieces(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return encode_column(docs, public_vocabulary())


QUERY = op1_unigram_pieces
SQL = None
