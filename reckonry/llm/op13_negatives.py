"""Hard negatives by an inverted multi-index with certified windows.

A vector's two halves are quantised by one codebook each; a pair of codes is a cell. With the radius of
every code (the largest distance of a row's half from its codeword) the half-scores ``q.c + |q| r`` and
``q.c - |q| r`` bound the inner product of any row of a cell from above and below. A heap visits an anchor's cells
by the sum of the upper half-scores, the multi-sequence order.

Each search has two rounds, so no chain of rounds grows with the data. The first visits an anchor's best cells until
they hold ``SEED_ROWS`` rows; the k-th score found there bounds the k-th best of all rows from below. The second goes on along the heap
and stops at the first cell whose bound is below that, which certifies the window: rows of cells not visited can't
enter it. Results are exact; codebooks are fitted on a bounded sample and only decide how much is visited.

Cells lie on shelves of at most about ``SHELF`` rows: small cells share one, a large cell (copies of one vector, say)
fills several. A shelf and a bounded block of anchors meet in one task and are scored by one matrix product.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from reckonry.plans.staging import stage

CODES, SAMPLE, FIT_ROUNDS = 16, 8192, 12
SHELF, ANCHORS_A_BLOCK, SEED_ROWS = 8192, 2048, 4096


@dataclass(frozen=True)
class Index:
    """Codebooks, radii and where the cells lie. All parts are as large as the codebooks, whatever the rows.

    ``first[c]`` is a cell's first shelf, ``parts[c]`` how many it fills, ``rows[c]`` its rows.
    """

    books: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    rows: np.ndarray
    first: np.ndarray
    parts: np.ndarray

    def half_scores(self, q: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Upper and lower bounds of the inner product of each half with rows of each code.

        Rounding of doubles is far below the slack of a millionth of the norms.
        """
        cut, upper, lower = self.books[0].shape[1], [], []
        for part, book, radius in zip((q[:cut], q[cut:]), self.books, self.radii):
            middle, spread = book @ part, np.linalg.norm(part) * radius
            slack = 1e-6 * (1 + np.abs(middle) + spread)
            upper.append(middle + spread + slack)
            lower.append(middle - spread - slack)
        return upper, lower

    def visits(self, q: np.ndarray) -> Iterator[tuple[int, float, float]]:
        """(cell, upper bound, lower bound) of all cells with rows, the greatest upper bound first."""
        (upper, upper2), (lower, lower2) = self.half_scores(q)
        one, two = np.argsort(-upper, kind="stable"), np.argsort(-upper2, kind="stable")
        heap = [(-(upper[one[0]] + upper2[two[0]]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            if j + 1 < len(two):
                heapq.heappush(heap, (-(upper[one[i]] + upper2[two[j + 1]]), i, j + 1))
            if j == 0 and i + 1 < len(one):
                heapq.heappush(heap, (-(upper[one[i + 1]] + upper2[two[0]]), i + 1, 0))
            cell = int(one[i]) * len(two) + int(two[j])
            if self.rows[cell]:
                yield cell, -bound, lower[one[i]] + lower2[two[j]]

    def shelves(self, cell: int) -> range:
        return range(int(self.first[cell]), int(self.first[cell] + self.parts[cell]))

    def seeds(self, q: np.ndarray, low: float, high: float, enough: int) -> list[int]:
        """Shelves of the first cells that may score within [low, high], until they hold ``enough`` rows."""
        found, held = {}, 0
        for cell, upper, lower in self.visits(q):
            if upper < low or held >= enough:
                break
            if lower <= high:
                found |= dict.fromkeys(self.shelves(cell))
                held += int(self.rows[cell])
        return list(found)

    def rest(self, q: np.ndarray, windows: list[tuple[float, float]]) -> list[int]:
        """Shelves of all cells that may score within one of the windows."""
        found, least = {}, min(low for low, _ in windows)
        for cell, upper, lower in self.visits(q):
            if upper < least:
                break  # certified: no cell further down the heap reaches a window
            if any(upper >= low and lower <= high for low, high in windows):
                found |= dict.fromkeys(self.shelves(cell))
        return list(found)


def fitted(sample: np.ndarray, codes: int, seed: int = 7) -> np.ndarray:
    """``codes`` codewords by Lloyd's rounds over a bounded sample; fewer rows repeat."""
    draw = np.random.default_rng(seed)
    book = sample[draw.choice(len(sample), codes, replace=len(sample) < codes)]
    for _ in range(FIT_ROUNDS):
        own = nearest(sample, book)[0]
        size = np.bincount(own, minlength=codes)
        sums = np.zeros_like(book)
        np.add.at(sums, own, sample)
        book = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], book)
    return book


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest codeword of each row, and the distance to it."""
    own = np.argmin((book**2).sum(1) - 2 * rows @ book.T, axis=1) if len(rows) else np.zeros(0, int)
    return own, np.linalg.norm(rows - book[own], axis=1)


def _matrix(column, width: int) -> np.ndarray:
    """Whole numbers of list cells as a matrix; columns of Arrow or pandas."""
    flat = column.flatten().to_numpy() if isinstance(column, pa.Array) else np.concatenate(column.to_numpy()) if len(column) else np.zeros(0, np.int64)
    return flat.reshape(-1, width)


def scores_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in doubles where these hold them, else in 64 bits; beyond that it raises."""
    most = a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if most >= 1 << 63:
        raise ValueError("inner products beyond 64 bits; scale the vectors down")
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if most < 1 << 53 else a @ b.T


# ---------------------------------------------------------------- tables

def usable(embeddings: DataFrame, moved: bool = True) -> tuple[DataFrame, int]:
    """(rows that take part, their width): row, vec_id, label, v (whole numbers ``floor(256 x)``).

    Shorter vectors are filled up with zeros, an empty one scores 0 with all. ``row`` tells apart rows that repeat a
    vec_id. ``moved`` gives rows whose vec_id is divisible by 7 the next of ten labels.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    label = F.col("label").cast("long")
    label = F.when(F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False)), (label + 1) % 10).otherwise(label) if moved else label
    rows = embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(fine).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("v"))
    rows = stage(rows, "vectors")  # written, so that a row keeps its number
    width = max(rows.agg(F.max(F.size("v"))).first()[0] or 0, 2)
    fill = F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v"))
    return rows.withColumn("v", F.concat("v", fill)), width


def indexed(rows: DataFrame, width: int, codes: int = CODES, sample: int = SAMPLE, shelf: int = SHELF) -> tuple[DataFrame, Index]:
    """Rows with their shelf, and the index over all of them.

    At most ``sample`` rows, drawn from all by a hash of their number, come to the driver to fit the codebooks; every row is
    indexed. What else comes to the driver is one line a cell, ``codes`` squared at most.
    """
    total, cut = rows.count(), width // 2
    chosen = rows if total <= sample else rows.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int((1 << 30) * sample / total))
    drawn = _matrix(chosen.select("v").limit(2 * sample).toArrow().column("v").combine_chunks(), width).astype(float)
    books = (fitted(drawn[:, :cut], codes), fitted(drawn[:, cut:], codes))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), width).astype(float)
            (i, far), (j, far2) = nearest(v[:, :cut], books[0]), nearest(v[:, cut:], books[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(i * codes + j, pa.int32()), pa.array(far), pa.array(far2)],
                                             [*batch.schema.names, "cell", "far", "far2"])

    celled = stage(rows.mapInArrow(work, "row long, vec_id long, label long, v array<long>, cell int, far double, far2 double"), "cells")
    radii, held = (np.zeros(codes), np.zeros(codes)), np.zeros(codes * codes, np.int64)
    for cell, n, far, far2 in celled.groupBy("cell").agg(F.count("*"), F.max("far"), F.max("far2")).collect():  # codes squared at most
        held[cell] = n
        radii[0][cell // codes], radii[1][cell % codes] = max(radii[0][cell // codes], far), max(radii[1][cell % codes], far2)
    first, parts, at, room = np.zeros(codes * codes, np.int64), np.zeros(codes * codes, np.int64), 0, shelf
    for cell in np.flatnonzero(held):
        if held[cell] > room and room < shelf:
            at, room = at + 1, shelf
        first[cell], parts[cell] = at, -(-held[cell] // shelf)
        if held[cell] >= room:
            at, room = at + parts[cell], shelf
        else:
            room -= held[cell]
    index = Index(books, radii, held, first, parts)
    layout = rows.sparkSession.createDataFrame([(int(c), int(first[c]), int(parts[c])) for c in np.flatnonzero(held)], "cell int, first int, parts int")
    lying = F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    return celled.join(F.broadcast(layout), "cell").select("row", "vec_id", "label", "v", lying.alias("shelf")), index


ANCHOR = "row long, vec_id long, label long, v array<long>, windows array<struct<w:int,low:long,high:long>>"
FOUND = "row long, w int, found_row long, found_id long, score long"


def _requests(anchors: DataFrame, index: Index, width: int, blocks: int, pick) -> DataFrame:
    """Anchors once for each shelf that they visit; ``pick(index, q, windows, seen)`` gives the shelves."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column("v"), width).astype(float)
            windows = [[(w["low"], w["high"]) for w in ws] for ws in batch.column("windows").to_pylist()]
            seen = batch.column("seen").to_pylist() if "seen" in batch.schema.names else [None] * len(q)
            shelves = [pick(index, *x) for x in zip(q, windows, seen)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "vec_id", "label", "v", "windows")), pa.array(shelves, pa.list_(pa.int32()))],
                                             ["row", "vec_id", "label", "v", "windows", "shelves"])

    return anchors.mapInArrow(work, f"{ANCHOR}, shelves array<int>").withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))


def _scored(rows: DataFrame, requests: DataFrame, width: int, blocks: int, k: int, same_label: bool) -> DataFrame:
    """The k best of each shelf for each anchor and window: score within [low, high], label the same or another, ties by vec_id."""

    def work(asked: pd.DataFrame, lying: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(lying):
            v, label, row = _matrix(lying["v"], width), lying["label"].to_numpy(), lying["row"].to_numpy()
            ids = lying["vec_id"]
            last = ids.isna().to_numpy()  # a null vec_id comes after all others
            order_id = ids.fillna(0).to_numpy().astype(np.int64)
            for low in range(0, len(asked), 256):
                part = asked.iloc[low:low + 256]
                scores = scores_of(_matrix(part["v"], width), v)
                for s, own, own_label, windows in zip(scores, part["row"], part["label"], part["windows"]):
                    fits = (label == own_label) & (row != own) if same_label else label != own_label
                    for w in windows:
                        at = np.flatnonzero(fits & (s >= w["low"]) & (s <= w["high"]))
                        if len(at) > k:
                            at = at[s[at] >= np.partition(s[at], -k)[-k]]
                        for x in at[np.lexsort((row[at], order_id[at], last[at], -s[at]))[:k]]:
                            out.append((own, w["w"], row[x], None if last[x] else order_id[x], s[x]))
        made = pd.DataFrame(out, columns=["row", "w", "found_row", "found_id", "score"])
        return made.astype({"found_id": "Int64"})

    asked = requests.select(*(c.split()[0] for c in ANCHOR.split(", ", 4)), F.explode("shelves").alias("shelf"), "block")
    laid = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return asked.groupBy("shelf", "block").cogroup(laid.groupBy("shelf", "block")).applyInPandas(work, FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    """The first k of each anchor and window, with ``rank`` from 1."""
    order = Window.partitionBy("row", "w").orderBy(F.col("score").desc(), F.col("found_id").asc_nulls_last(), "found_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def searched(rows: DataFrame, index: Index, anchors: DataFrame, width: int, k: int, same_label: bool,
             block: int = ANCHORS_A_BLOCK, seed_rows: int = SEED_ROWS) -> DataFrame:
    """The exact first k rows of each of an anchor's ``windows``, over all rows: row, w, found_row, found_id, score, rank."""
    blocks = max(1, -(-anchors.count() // block))

    def first(index, q, windows, _):
        return index.seeds(q, min(a for a, _ in windows), max(b for _, b in windows), seed_rows) if windows else []

    def others(index, q, windows, seen):
        return sorted(set(index.rest(q, windows)) - set(seen)) if windows else []

    asked = stage(_requests(anchors, index, width, blocks, first), "seeds")
    begun = stage(best(_scored(rows, asked, width, blocks, k, same_label), k), "seeded")
    # the k-th score so far narrows a window from below; fewer than k leave it as it is
    reached = begun.where(F.col("rank") == k).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("reached"))
    narrowed = F.transform("windows", lambda w: F.struct(w["w"].alias("w"), F.greatest(w["low"], F.get(F.array(F.col("reached")[w["w"]]), 0)).alias("low"), w["high"].alias("high")))
    again = asked.join(reached, "row", "left").select("row", "vec_id", "label", "v", narrowed.alias("windows"), F.col("shelves").alias("seen"))
    more = _scored(rows, _requests(again, index, width, blocks, others), width, blocks, k, same_label)
    return best(begun.drop("rank").unionByName(more), k)


def windows_column(windows: list[tuple[int, Column, Column]]) -> Column:
    return F.array(*(F.struct(F.lit(w).cast("int").alias("w"), low.cast("long").alias("low"), high.cast("long").alias("high")) for w, low, high in windows))


def hard_negatives(embeddings: DataFrame, anchor_step: int = 100, positives: int = 5, negatives: int = 10,
                   least_percent: int = 30, most_percent: int = 90, codes: int = CODES, sample: int = SAMPLE, shelf: int = SHELF,
                   block: int = ANCHORS_A_BLOCK, seed_rows: int = SEED_ROWS) -> DataFrame:
    """For each anchor (vec_id divisible by ``anchor_step``) and each of its first positives, the first negatives whose score is within the percentages of the positive's.

    Rows without a label or with a null, NaN or infinite component take no part. Rows that repeat a
    vec_id are rows of their own, a null vec_id comes last among ties. Windows of negative positives are empty.
    """
    rows, width = usable(embeddings)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark = embeddings.sparkSession
    if rows.isEmpty():
        return spark.createDataFrame([], schema)
    rows, index = indexed(rows, width, codes, sample, shelf)
    rows = stage(rows, "shelves")
    anchors = rows.where(F.col("vec_id") % anchor_step == 0).drop("shelf")
    whole = windows_column([(0, F.lit(-(1 << 62)), F.lit(1 << 62))])
    near = stage(searched(rows, index, anchors.withColumn("windows", whole), width, positives, True, block, seed_rows), "positives")

    low = F.ceil((F.col("score") * least_percent).cast("decimal(38,0)") / 100)
    high = F.floor((F.col("score") * most_percent).cast("decimal(38,0)") / 100)
    own = near.withColumn("low", low.cast("long")).withColumn("high", high.cast("long")).where("low <= high").groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct(F.col("rank").alias("w"), "low", "high"))).alias("windows"))  # one line a positive
    far = searched(rows, index, anchors.join(own, "row"), width, negatives, False, block, seed_rows)
    named = near.join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row").select(
        "row", "anchor_id", F.col("rank").alias("w"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(named, ["row", "w"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{folder}/embeddings.parquet"))


QUERY = op13_hard_negatives
#: Every anchor against all rows.
SQL = """
with fine as (
  select vec_id, cast(label as bigint) as label, embedding, row_number() over () as row from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
rows as (
  select row, vec_id, if(coalesce(vec_id % 7 = 0, false), (label + 1) % 10, label) as label,
    list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from fine),
pairs as (
  select a.row as a_row, a.vec_id as anchor_id, b.row as b_row, b.vec_id as other_id, a.label = b.label as same,
    cast(coalesce(list_sum(list_transform(list_zip(a.v, b.v, true), lambda p: p[1] * p[2])), 0) as bigint) as score
  from rows a, rows b where a.vec_id % 100 = 0 and a.row <> b.row),
positives as (
  select a_row, anchor_id, other_id as positive_id, score as positive_score,
    row_number() over (partition by a_row order by score desc, other_id nulls last, b_row) as p from pairs where same qualify p <= 5)
select p.anchor_id, positive_id, cast(row_number() over (partition by p.a_row, p order by n.score desc, n.other_id nulls last, n.b_row) as integer) as rank,
  n.other_id as negative_id, positive_score, n.score as negative_score
from positives p join pairs n on n.a_row = p.a_row and not n.same and 100 * n.score between 30 * positive_score and 90 * positive_score
qualify rank <= 10
"""
