"""MinHash near-duplicates: universal minima in bands, checks on full sets, star components.

1. Each text becomes its set of distinct 5-word shingles. Texts with equal sets fold into one
   representative, so copies, however many, cost one row from there on.
2. ``hashes`` universal functions ``a*x + b mod 2**64`` give a signature; ``rows`` minima make a
   band. A pair of similarity s shares no band with probability ``(1 - s**rows)**bands``: below
   2e-7 at 0.85 for 27 bands of 5.
3. Members of a band bucket meet its pivots, never each other all at once, and a pair meets in the first
   band that it shares only. Its signatures are compared: where too few minima agree for the
   similarity asked for (six standard deviations too few), it goes. A pair counts only when the full sets agree. Pivots that met all others leave the bucket, members of one component need
   no more checks, and the number of pivots grows each round until no bucket holds two
   components: every candidate pair that could still join two components has then been checked.
   Shingles that only one set has bound its intersections from above, which spares edited copies
   that can link with nothing, and lets the least edited one be the pivot.
4. Components come from alternating large-star and small-star.

Every round is written to the shared checkpoint folder. Nothing about documents goes to the driver
but row counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from reckonry.llm.batches import slices
from reckonry.llm.keys import written_keys
from reckonry.llm.words import mix, shingles_of, words_of
from reckonry.plans.staging import stage


#: Bytes of text that a task works on at once, with some twenty times as much beside them.
BATCH = 4 << 20


@dataclass(frozen=True)
class MinHash:
    size: int = 5
    rows: int = 5
    bands: int = 27
    percent: int = 85
    seed: int = 7

    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        n = self.rows * self.bands
        drawn = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(self.seed))
        return drawn[:n] | np.uint64(1), drawn[n:]

    @property
    def agreeing(self) -> int:
        """Minima that agree in all but about one in a billion of the pairs at the similarity asked for."""
        n, s = self.rows * self.bands, self.percent / 100
        return max(0, int(n * s - 6 * (n * s * (1 - s)) ** 0.5))


def _sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one after another, and their bounds."""
    words = words_of(texts)
    shingles, begin = shingles_of(words.hashes(lower=True), words.first, size)
    own = [np.unique(shingles[begin[i]:begin[i + 1]]) for i in range(len(begin) - 1)]
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in own], dtype=np.int64)))
    return np.concatenate(own) if own else np.empty(0, np.uint64), bounds


def _minima(hashes: np.ndarray, bounds: np.ndarray, spec: MinHash) -> tuple[np.ndarray, np.ndarray]:
    """For each non-empty set its ``spec.bands`` band keys, and 16 bits of each minimum."""
    a, b = spec.functions()
    full = np.flatnonzero(np.diff(bounds))
    keys, bits = np.zeros((len(full), spec.bands), np.uint64), np.zeros((len(full), len(a)), np.int16)
    at = 0
    while at < len(full):  # pieces that stay in the cache
        until = max(at + 1, int(np.searchsorted(bounds[full], bounds[full[at]] + (1 << 16), "left")))
        low = bounds[full[at]]
        piece = hashes[low:bounds[full[until - 1] + 1]]
        cuts, value = bounds[full[at:until]] - low, np.empty_like(piece)
        for k in range(len(a)):
            np.multiply(piece, a[k], out=value)
            value += b[k]
            least = np.minimum.reduceat(value, cuts)
            bits[at:until, k] = mix(least).astype(np.uint16).view(np.int16)
            keys[at:until, k // spec.rows] = (keys[at:until, k // spec.rows] + least) * np.uint64(0xC2B2AE3D27D4EB4F)
        at = until
    return mix(keys + np.arange(1, spec.bands + 1, dtype=np.uint64)), bits


def signatures(docs: DataFrame, spec: MinHash) -> DataFrame:
    """doc_id, n_shingles, set_key (two words that stand for the set), bands and minima (empty for an empty set)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, BATCH):
                hashes, bounds = _sets(part.column("text"), spec.size)
                counts, (keys, bits) = np.diff(bounds), _minima(hashes, bounds, spec)
                full, key = counts > 0, np.zeros((len(counts), 2), np.uint64)
                if full.any():
                    cuts = bounds[:-1][full]
                    key[full, 0] = np.add.reduceat(mix(hashes), cuts)
                    key[full, 1] = np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), cuts)
                ends = np.concatenate(([0], np.cumsum(full)))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(counts, pa.int64()),
                    pa.array(key[:, 0].view(np.int64)), pa.array(key[:, 1].view(np.int64)),
                    *(pa.ListArray.from_arrays(pa.array((ends * x.shape[1]).astype(np.int32)), pa.array(x.ravel())) for x in (keys.view(np.int64), bits)),
                ], ["doc_id", "n_shingles", "key_a", "key_b", "bands", "minima"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        work, "doc_id long, n_shingles long, key_a long, key_b long, bands array<long>, minima array<short>")


def shingle_sets(docs: DataFrame, spec: MinHash) -> DataFrame:
    """doc_id and its sorted distinct shingle hashes, for the rows given."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, BATCH):
                hashes, bounds = _sets(part.column("text"), spec.size)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, shingles array<long>")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``; component is the smallest node reachable.

    Large-star and small-star alternate until neither changes the edges. Each is a minimum per node
    (summed up before the shuffle) joined back to the edges; a node with very many edges is split by
    adaptive skew joins.
    """
    edges = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), name)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large, name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = stage(small.where("u <> v").distinct(), name)
        # done when every node hangs on one root and no root hangs on another
        torn = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u").union(
            edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi"))
        if torn.isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame, spec: MinHash = MinHash()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts link when ``100 * |A & B| >= percent * |A | B|`` on their shingle sets. Null and empty
    texts have empty sets, link with nothing and are kept. Every row gives a row, repeated ones too;
    if one doc_id carries several texts, a link of any of them counts for it. A null doc_id has a null
    component and is kept.
    Columns other than doc_id and text are not read.
    """
    signed = stage(signatures(docs, spec), "signatures")
    known = signed.where("n_shingles > 0 and doc_id is not null")
    folded = stage(
        known.groupBy("key_a", "key_b").agg(F.min(F.struct("doc_id", "n_shingles", "bands", "minima")).alias("r"))
        .select("key_a", "key_b", F.col("r.doc_id").alias("rep"), "r.n_shingles", "r.bands", "r.minima"), "folded")
    linked = _linked(docs, folded, spec)
    named = folded.select("key_a", "key_b", "rep").join(linked, folded["rep"] == linked["node"], "left").select(
        "key_a", "key_b", F.coalesce("component", "rep").alias("component"))
    out = signed.join(named, ["key_a", "key_b"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
                      (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"))


def _linked(docs: DataFrame, folded: DataFrame, spec: MinHash) -> DataFrame:
    """(node, component) of representatives that link with another."""
    spark = docs.sparkSession
    # buckets of two or more; their members are few beside all band rows
    banded = folded.select("rep", "n_shingles", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    members = stage(banded.join(shared, "band"), "members")
    found = spark.createDataFrame([], "node long, component long")
    if not members.head(1):
        return found
    some = written_keys(members.select("rep").distinct(), "candidates")
    sets = stage(shingle_sets(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(some, F.col("doc_id") == F.col("rep"), "left_semi"), spec)
        .where(F.size("shingles") > 0).dropDuplicates(["doc_id", "shingles"]), "sets")
    # what a set shares with no other can't be in any intersection
    alone = sets.select("doc_id", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(
        F.min("doc_id").alias("rep"), F.max("doc_id").alias("high")).where("rep = high").groupBy("rep").agg(F.count("*").alias("own"))
    several = sets.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("rep"))  # ids with two texts
    alone = alone.join(several, "rep", "left_anti")
    # signatures ride with the members, so that a pair is judged where it meets; an id with two texts has several
    of_rep = stage(folded.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "n_shingles", "bands", "minima"), "signed")
    members = members.join(alone, "rep", "left").join(of_rep, ["rep", "n_shingles"]).where(F.array_contains("bands", F.col("band"))).select(
        "band", "rep", "n_shingles", "bands", "minima", F.coalesce("own", F.lit(0)).alias("own"), F.col("rep").alias("component"), F.lit(False).alias("linked"))
    met = spark.createDataFrame([], "x long, y long")
    pivots = 1
    while True:
        members = stage(_torn(members, spec), "members")
        if not members.head(1):
            return found
        lead = _leads(members, pivots)
        most = "least(n_shingles - own, lead_shingles - lead_own)"
        pairs = members.join(lead, "band").where(
            f"component <> lead_component and 100 * {most} >= {spec.percent} * (n_shingles + lead_shingles - {most})"
            " and element_at(array_intersect(bands, lead_bands), 1) = band"  # in bands' order: the first that both have
            f" and size(filter(zip_with(minima, lead_minima, (a, b) -> a = b), same -> same)) >= {spec.agreeing}"
        ).select(F.least("rep", "lead").alias("x"), F.greatest("rep", "lead").alias("y"), F.least("component", "lead_component").alias("low"),
                 F.greatest("component", "lead_component").alias("high")).distinct()
        pairs = stage(pairs.join(met, ["x", "y"], "left_anti"), "pairs")
        if pairs.head(1):
            met = met.union(pairs.select("x", "y"))
            a = sets.select(F.col("doc_id").alias("x"), F.col("shingles").alias("one"))
            b = sets.select(F.col("doc_id").alias("y"), F.col("shingles").alias("two"))
            both = F.size(F.array_intersect("one", "two"))
            good = stage(pairs.join(a, "x").join(b, "y").where(100 * both >= spec.percent * (F.size("one") + F.size("two") - both)).select(
                F.col("high").alias("u"), F.col("low").alias("v")).distinct(), "links")
            if good.head(1):  # links between components so far: a small graph after the first round
                merged = components(good)
                moved = merged.select(F.col("node").alias("component"), F.col("component").alias("into"))
                found = stage(found.join(moved, "component", "left").select("node", F.coalesce("into", "component").alias("component")).union(
                    merged.select("node", "component")).distinct(), "found")
        # pivots have met every other component's members of their buckets, so they leave
        rest = members.select("band", "rep", "n_shingles", "bands", "minima", "own").join(lead.select("band", F.col("lead").alias("rep")), ["band", "rep"], "left_anti")
        members = rest.join(found, F.col("rep") == F.col("node"), "left").select(
            "band", "rep", "n_shingles", "bands", "minima", "own", F.coalesce("component", "rep").alias("component"), F.col("node").isNotNull().alias("linked"))
        pivots *= 8


def _torn(members: DataFrame, spec: MinHash) -> DataFrame:
    """Members of buckets that hold two components, without those that can link with no other there.

    A set of n shingles, ``own`` of them in no other set, meets a set of m shingles in n - own at most;
    even with the bucket's smallest set that may be too few for the ratio.
    """
    small = members.groupBy("band").agg(F.min("n_shingles").alias("small"))
    able = members.join(small, "band").where(
        f"100 * (n_shingles - own) >= {spec.percent} * (own + greatest(small, n_shingles - own))").drop("small")
    torn = able.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band")
    return able.join(torn, "band")


def _leads(members: DataFrame, pivots: int) -> DataFrame:
    """Up to ``pivots`` members of each bucket: those that link with nothing yet first, least of their own first.

    At the start these are likely originals, later the few that stand apart. The order is the same in all bands, so bands agree. Spark limits each bucket within the tasks
    before the shuffle, so a bucket of any size is safe.
    """
    order = Window.partitionBy("band").orderBy("linked", "own", "rep")
    return members.withColumn("k", F.row_number().over(order)).where(f"k <= {pivots}").select(
        "band", F.col("rep").alias("lead"), F.col("n_shingles").alias("lead_shingles"), F.col("own").alias("lead_own"), F.col("bands").alias("lead_bands"), F.col("minima").alias("lead_minima"),
        F.col("component").alias("lead_component"))


def op7_minhash_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"))


QUERY = op7_minhash_neardup
SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents
), s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end) g from d
), n as (select doc_id, count(*) n from s group by 1
), rare as (select g from s group by g having count(*) > 1
), p as (
  select a.doc_id u, b.doc_id v, count(*) k from s a join s b on a.g = b.g and a.doc_id < b.doc_id
  where a.g in (select g from rare) group by all
), e as (
  select u, v from p join n x on x.doc_id = u join n y on y.doc_id = v where 100 * k >= 85 * (x.n + y.n - k)
), both_ways as (select u, v from e union all select v, u from e
), r(node, reach) as (select u, u from both_ways union select r.node, b.v from r join both_ways b on r.reach = b.u
), c as (select node, min(reach) m from r group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(c.m, d.doc_id)::bigint as component_id,
  coalesce(c.m, d.doc_id) = d.doc_id as kept
from d left join n on n.doc_id = d.doc_id left join c on c.node = d.doc_id
"""
