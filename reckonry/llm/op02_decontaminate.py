"""Benchmark passages in documents: SimHash of item-sized windows, Hamming blocks, exact check.

* A window is as long as an item, in 5-word shingles (shorter at a text's ends), and starts anywhere. It
  is made if shingles of the benchmark, whatever their places in an item, fill at least ``least``
  percent of it: the similarity is never above that share, so this leaves out nothing, and only it
  makes the rest payable. Fingerprints of every window of every size in the benchmark would cost some
  hundred times the shingles themselves.
* Windows of equal content, however many documents hold them, get one fingerprint: 128 SimHash bits,
  each the majority of that bit over the window's shingles with their multiplicities.
* 16 blocks of 8 bits index the items, each with its value and the 8 values one bit away: two
  fingerprints that differ in at most 31 bits agree on a block but for one bit, so all of them meet.
  At 0.8 some 19 bits differ; pairs beyond 31 bits still meet unless every block differs twice.
* A pair that met counts if the multiset similarity ``sum(min) / sum(max)`` of shingle counts is at
  least ``least`` percent.

All steps are DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reckonry.llm.keys import written_keys
from reckonry.llm.native import with_shingles
from reckonry.plans.staging import stage

LEAST, BITS, BLOCK_BITS = 80, 128, 8
#: An item table of more shingles than this is joined by a shuffle and not sent to every task.
BROADCAST_SHINGLES = 2_000_000


def fingerprint_blocks(window: str) -> F.Column:
    """The SimHash of an array of shingle hashes as 16 block values."""
    halves = [f"transform(sequence(0, 63), b -> if(aggregate({w}, 0, (s, x) -> s + if((shiftright(x, b) & 1) = 1, 1, -1)) > 0, 1, 0))"
              for w in (window, f"transform({window}, x -> xxhash64(x))")]
    bits = f"concat({halves[0]}, {halves[1]})"
    blocks = f"transform(sequence(0, {BITS // BLOCK_BITS - 1}), k -> aggregate(slice(bits, k * {BLOCK_BITS} + 1, {BLOCK_BITS}), 0, (v, x) -> 2 * v + x))"
    return F.expr(f"transform(array({bits}), bits -> {blocks})[0]")


def _common(a: str, b: str) -> F.Column:
    """Sum over shingles of the smaller of their counts in two arrays."""
    return F.expr(f"aggregate(array_distinct({a}), 0, (s, x) -> s + least(size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x))))")


def _starts(least: int) -> str:
    """Windows of size m in a text of n shingles whose positions ``ps`` are filled, each as start * 2**31 + length.

    A window with k filled positions of which ps[i] is the first starts in a range that follows from
    ps[i] and ps[i + k - 1]; beginnings and ends of the text, shorter than m, are tried one by one.
    """
    k = f"int(({least} * m + 99) div 100)"
    low, high = f"greatest(ps[i + {k} - 1] - m + 1, 0)", "least(ps[i], n - m)"
    full = (f"if(size(ps) >= {k} and n >= m, flatten(transform(filter(sequence(0, size(ps) - {k}), i -> ps[i + {k} - 1] - ps[i] < m), "
            f"i -> transform(sequence({low}, {high}), s -> shiftleft(bigint(s), 31) + m))), array())")
    ends = []
    for start, inside, part in (("0", "p < l", "slice(ps, 1, m)"), ("n - l", "p >= n - l", "slice(ps, greatest(size(ps) - m, 0) + 1, m)")):
        ends.append(f"if(least(m - 1, n) > 0, transform(filter(sequence(1, greatest(least(m - 1, n), 1)), l -> 100 * size(filter({part}, p -> {inside})) >= {least} * l), "
                    f"l -> shiftleft(bigint({start}), 31) + l), array())")
    return f"array_distinct(concat({full}, {ends[0]}, {ends[1]}))"


def windows(docs: DataFrame, items: DataFrame, limit: int = BROADCAST_SHINGLES, least: int = LEAST) -> DataFrame:
    """doc_id, start (in shingles), window, aligned: item-sized stretches filled with shingles of the benchmark.

    ``aligned``: some shingle has the same place in the window and in an item of its size.
    """
    places = stage(items.select(F.posexplode("shingles").alias("q", "shingle"), F.size("shingles").alias("size")).distinct().groupBy("shingle").agg(
        F.collect_list(F.struct("size", "q")).alias("places")), "places")
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    texts = with_shingles(docs, "h").select("row", "h", F.size("h").alias("n"))
    # posexplode_outer: the plain one would test the arrays' sizes before they are columns, text by text and shingle by shingle
    keyed = texts.select("row", "n", F.posexplode_outer("h").alias("p", "shingle"))
    hits = keyed.join(F.broadcast(places) if places.count() <= limit else places, "shingle")
    lines = hits.select("row", "n", "p", F.expr(
        "transform(places, x -> struct(x.size as size, shiftleft(bigint(greatest(p - x.q, 0)), 31) + least(x.size + least(p - x.q, 0), n - greatest(p - x.q, 0)) as line))").alias("lines"))
    filled = stage(lines.groupBy("row", "n").agg(F.sort_array(F.collect_set("p")).alias("ps"), F.flatten(F.collect_list("lines")).alias("lines")), "filled")
    sized = filled.select("row", "n", "ps", F.expr("array_distinct(transform(lines, x -> x.line))").alias("lines"),
                          F.explode(F.expr("array_distinct(transform(lines, x -> x.size))")).alias("m"))
    made = sized.select("row", "lines", F.expr(_starts(least)).alias("made")).where("size(made) > 0")
    found = stage(made.select("row", F.explode(F.expr(
        "concat(transform(array_intersect(made, lines), w -> struct(w, true as aligned)), transform(array_except(made, lines), w -> struct(w, false as aligned)))"
    )).alias("x")).select("row", "x.w", "x.aligned").distinct(), "window-places")
    rows = written_keys(found.select("row").distinct(), "window-rows")  # met before shingles are made again
    held = with_shingles(docs.join(rows, "row", "left_semi"), "h").select("row", "doc_id", "h")
    start, length = F.shiftright("w", 31).cast("int"), F.col("w").bitwiseAND((1 << 31) - 1).cast("int")
    return found.join(held, "row").select("doc_id", start.alias("start"), F.slice("h", start + 1, length).alias("window"), "aligned")


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, limit: int = BROADCAST_SHINGLES) -> DataFrame:
    """One row per document and benchmark item it holds: doc_id, item_id, start_word, similarity of the best window.

    Of equally similar windows an aligned one goes first, then the first in the text.

    Null and blank texts hold nothing, on either side; a text of fewer than five words is one shingle
    and is found where it is a whole document. Rows that share a doc_id share its rows here; a null
    doc_id is reported as null. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = stage(with_shingles(benchmark, "shingles").select("item_id", "shingles").where("size(shingles) > 0"), "items")
    ids = [F.xxhash64("window").alias("k1"), F.xxhash64(F.lit(1), "window").alias("k2")]
    placed = stage(windows(docs, items, limit, least).select("doc_id", "start", "window", "aligned", *ids), "windows")
    distinct = placed.groupBy("k1", "k2").agg(F.first("window").alias("window"))
    printed = stage(distinct.select("k1", "k2", "window", fingerprint_blocks("window").alias("blocks")), "fingerprints")
    item_prints = items.select("item_id", "shingles", F.posexplode(fingerprint_blocks("shingles")).alias("block", "own"))
    item_prints = item_prints.withColumn("value", F.explode(F.expr(f"concat(array(own), transform(sequence(0, {BLOCK_BITS - 1}), b -> own ^ shiftleft(1, b)))")))
    met = printed.select("k1", "k2", F.size("window").alias("n"), F.posexplode("blocks").alias("block", "value")).join(
        item_prints.select("item_id", F.size("shingles").alias("m"), "block", "value"), ["block", "value"]
    ).where(f"100 * n >= {least} * m and 100 * m >= {least} * n").select("k1", "k2", "item_id").distinct()
    both = met.join(printed.select("k1", "k2", "window"), ["k1", "k2"]).join(items, "item_id")
    both = both.where(F.arrays_overlap("window", "shingles"))  # most pairs that met by a block alone
    shared = both.select("k1", "k2", "item_id", F.size("window").alias("n"), F.size("shingles").alias("m"), _common("window", "shingles").alias("both"))
    good = shared.where(f"100 * both >= {least} * (n + m - both)").select("k1", "k2", "item_id", F.expr("both / (n + m - both)").alias("similarity"))
    return placed.select("doc_id", "start", "aligned", "k1", "k2").join(good, ["k1", "k2"]).groupBy("doc_id", "item_id").agg(
        F.max(F.struct("similarity", "aligned", (-F.col("start")).alias("s"))).alias("best")).select(
        "doc_id", "item_id", (-F.col("best.s")).cast("long").alias("start_word"), "best.similarity")


def op2_simhash_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))


QUERY = op2_simhash_decontamination
#: Every window against every item, without fingerprints.
SQL = r"""
with w as (
  select 'd' as side, doc_id as id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') w from documents
  union all select 'b', item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') from benchmark
), h as (
  select side, id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end as h from w
), s as (select side, id, len(h) as size, unnest(h) as g, unnest(range(len(h))) as p from h
), al as (select distinct g, p as q, size from s where side = 'b'
), hit as (
  select distinct s.id, greatest(s.p - al.q, 0) as start, al.size + least(s.p - al.q, 0) as length from s join al on al.g = s.g where s.side = 'd'
), win as (select hit.id, start, length, h.h[start + 1:start + length] as v from hit join h on h.id = hit.id and h.side = 'd'
), wg as (select id, start, length, g, count(*) as c from (select id, start, length, unnest(v) as g from win) group by all
), bg as (select id as item_id, g, count(*) as c from s where side = 'b' group by all
), both_ as (
  select wg.id, wg.start, wg.length, bg.item_id, sum(least(wg.c, bg.c)) as k from wg join bg on bg.g = wg.g group by all
), j as (
  select b.id as doc_id, b.item_id, b.start, b.k::double / (len(win.v) + len(i.h) - b.k) as similarity
  from both_ b join win on win.id = b.id and win.start = b.start and win.length = b.length join h i on i.side = 'b' and i.id = b.item_id
  where 100 * b.k >= 80 * (len(win.v) + len(i.h) - b.k)
)
select doc_id, item_id, arg_min(start, (-similarity, start))::bigint as start_word, max(similarity) as similarity from j group by all
"""
