"""Conversation structure repair by a generalised LR parse with edits.

The role grammar becomes an LR automaton. Each turn may be kept, given another role or deleted, and empty
turns may be put in anywhere; every choice that the automaton can shift makes a top of the stack graph, and
equal tops merge by the least (cost, audit). What a step does depends only on the tops and on one turn's
symbol, so steps are remembered, and one conversation costs a few table look-ups a turn.

Turns of a conversation are read in order, from sorted partitions. Beside a turn's symbol the parse keeps one
reference a turn, as the audit itself holds one letter a turn; texts never pass through it. They meet their
edits again by (conversation, place), keys that are spread over tasks however long one conversation is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from reckonry.plans.staging import stage
from reckonry.plans.sums import join_null_safe

# White space, the grammar of role initials, edits with their costs.
SPACES = " \t\n\x0b\x0c\r"
PRODUCTIONS = (("talk", ()), ("talk", ("s", "turns")), ("talk", ("turns",)), ("turns", ("turns", "u", "a")), ("turns", ("u", "a")))
ROLES = (("u", "user"), ("a", "assistant"))
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LEGAL = ("su", "ua", "au")


class Automaton:
    """LR states of a grammar; the first production's left side is the start.

    ``shifted(stack, terminal)`` gives every stack after the reductions that the terminal allows and its
    shift. A stack is a linked pair (state, stack below), so that stacks share what lies below their tops.
    """

    def __init__(self, productions=PRODUCTIONS):
        self.rules = (("", (productions[0][0],)), *productions)
        self.inner = {left for left, _ in self.rules}
        self.terminals = sorted({x for _, right in self.rules for x in right} - self.inner)
        self.states, self.goto = [self._closed({(0, 0)})], {}
        for state in self.states:  # grows meanwhile
            for symbol in {self.rules[r][1][dot] for r, dot in state if dot < len(self.rules[r][1])}:
                after = self._closed({(r, dot + 1) for r, dot in state if self.rules[r][1][dot:dot + 1] == (symbol,)})
                if after not in self.states:
                    self.states.append(after)
                self.goto[self.states.index(state), symbol] = self.states.index(after)
        self.follow = self._follow()
        self.start = (0, None)

    def _closed(self, items) -> frozenset:
        found = set(items)
        while more := {(k, 0) for r, dot in found for k, (left, _) in enumerate(self.rules)
                       if self.rules[r][1][dot:dot + 1] == (left,)} - found:
            found |= more
        return frozenset(found)

    def _follow(self) -> dict[str, set]:
        """Terminals, None for the end, that may come after each inner symbol."""
        empty: set[str] = set()
        first = {t: {t} for t in self.terminals} | {x: set() for x in self.inner}
        follow = {x: set() for x in self.inner}
        follow[""] = {None}
        size = -1
        while size != (size := len(empty) + sum(map(len, first.values())) + sum(map(len, follow.values()))):
            for left, right in self.rules:
                trailer = set(follow[left])
                for x in reversed(right):
                    if x in self.inner:
                        follow[x] |= trailer
                    trailer = trailer | first[x] if x in empty else set(first[x])
                for x in right:
                    first[left] |= first[x]
                    if x not in empty:
                        break
                else:
                    empty.add(left)
        return follow

    def _reduced(self, stack, ahead) -> list:
        """``stack`` and all that the reductions before ``ahead`` make of it."""
        found, at = [stack], 0
        while at < len(found):
            for r, dot in sorted(self.states[found[at][0]]):
                left, right = self.rules[r]
                if r and dot == len(right) and ahead in self.follow[left]:
                    below = found[at]
                    for _ in right:
                        below = below[1]
                    if (to := self.goto.get((below[0], left))) is not None and (to, below) not in found:
                        found.append((to, below))
            at += 1
        return found

    def shifted(self, stack, terminal: str) -> list:
        return [(to, x) for x in self._reduced(stack, terminal) if (to := self.goto.get((x[0], terminal))) is not None]

    def accepts(self, stack) -> bool:
        return any((0, 1) in self.states[state] for state, _ in self._reduced(stack, None))


@dataclass(frozen=True)
class Link:
    """How a top came about: the top before it, turns put in, the edit of the turn and its new role."""

    before: int
    inserted: tuple[str, ...]
    edit: str
    role: str | None

    @property
    def audit(self) -> str:
        return "I" * len(self.inserted) + self.edit


class Repair:
    """Cheapest edits that make a conversation's initials a word of the grammar.

    Tops are merged when their states are equal, which is right where equal states allow the same
    continuations, as in every left-recursive regular grammar. Tops stay sorted by their audits: all
    of them end with the edit of the same turn, so no audit is the beginning of another, and an
    extension is compared by the place of the one before it and then by its own letters.
    """

    def __init__(self, automaton: Automaton | None = None, roles=ROLES):
        self.automaton = automaton or Automaton()
        self.roles = roles
        self.first = ((self.automaton.start, 0),)
        self.step = lru_cache(1 << 14)(self._step)
        self.ways = lru_cache(1 << 10)(self._ways)

    def _ways(self, stack) -> tuple:
        """(stack, turns put in): the fewest that lead to each top."""
        found, at = [(stack, ())], 0
        while at < len(found):
            below, put = found[at]
            for t, role in self.roles:
                found += [(x, (*put, role)) for x in self.automaton.shifted(below, t) if all(x[0] != y[0] for y, _ in found)]
            at += 1
        return tuple(found)

    def _step(self, tops, symbol):
        """(tops after one turn, the cost that all of them have in common, a link for each)."""
        initial, required, truncated = symbol
        more = TRUNCATED if truncated else 0
        best = {}
        for k, (stack, cost) in enumerate(tops):
            for x, put in self.ways(stack):
                paid = cost + INSERT * len(put)
                made = [(x, paid + DELETE, Link(k, put, "D", None))]
                if not required:
                    if initial in self.automaton.terminals:
                        made += [(y, paid + KEEP + more, Link(k, put, "K", None)) for y in self.automaton.shifted(x, initial)]
                    made += [(y, paid + REROLE + more, Link(k, put, "R", role)) for t, role in self.roles
                             for y in self.automaton.shifted(x, t)]
                for y, total, link in made:
                    key = (total, k, link.audit)
                    if y[0] not in best or key < best[y[0]][0]:
                        best[y[0]] = (key, y, link)
        kept = sorted(best.values(), key=lambda b: b[0][1:])
        least = min(b[0][0] for b in kept)
        return tuple((stack, key[0] - least) for key, stack, _ in kept), least, tuple(link for *_, link in kept)

    def end(self, tops) -> tuple[int, int, tuple[str, ...]] | None:
        """(cost beyond the common one, top, turns put in at the end) of the cheapest accepted top."""
        return min(((cost + INSERT * len(put), k, put) for k, (stack, cost) in enumerate(tops)
                    for x, put in self.ways(stack) if self.automaton.accepts(x)), key=lambda c: (c[0], c[1], len(c[2])))

    def backward(self, symbols) -> Iterator[tuple[str, int | None, str | None]]:
        """The edits from the last to the first, for symbols (initial, deletion required, truncated).

        An edit is (letter, turn or None, new role or None). One reference a turn is kept; the links are shared.
        """
        tops, trail = self.first, []
        for symbol in symbols:
            tops, _, links = self.step(tops, symbol)
            trail.append(links)
        _, k, put = self.end(tops)
        yield from (("I", None, role) for role in reversed(put))
        for turn in range(len(trail) - 1, -1, -1):
            link = trail[turn][k]
            yield link.edit, turn, link.role
            yield from (("I", None, role) for role in reversed(link.inserted))
            k = link.before


# ---------------------------------------------------------------- tables

def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after the given damage: which one follows from the CRC of ``conv_id:turn``. A null reads as one space there, as role and as text.

    ``rank`` orders a conversation's rows: by turn, nulls first; rows of one turn by their role and
    text before the damage, a repeat right after its row. Other columns are left out.
    """
    blank = F.lit(" ")
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))) % 20
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind != 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        F.col("role").alias("old_role"), F.col("text").alias("old_text"),
    ).withColumn("rank", F.struct("old_role", "old_text", "copy")).drop("old_role", "old_text", "copy")


def with_faults(rows: DataFrame, then: tuple[str, ...] = ()) -> DataFrame:
    """Rows with ``place`` in their conversation and ``fault``: blank, duplicate, truncated or null, the first that holds.

    Rows go by turn, nulls first, then by the columns of ``then``, then by role and text. Null roles and texts
    count as empty; other columns are left out. ``illegal`` is whether the row and the one before it in its conversation have initials that may not meet.
    """
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
                       F.struct(F.lit(0), *(F.col(f"`{c}`") for c in then)).alias("rank"))
    order = [F.col("turn").asc_nulls_first(), F.col("rank"), F.col("role"), F.col("text")]
    core = F.rtrim("text", F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    in_order = Window.partitionBy("conv_id").orderBy(*order)
    same = Window.partitionBy("conv_id", "role", "text").orderBy(*order[:2])
    fault = (F.when(core == "", "blank").when(F.col("seen") > 1, "duplicate")
             .when(~F.right(core, F.lit(1)).isin(".", "!", "?"), "truncated"))
    pair = F.concat(F.lag(initial).over(in_order), initial)
    # one exchange by conversation serves both windows
    return rows.repartition("conv_id").withColumn("seen", F.row_number().over(same)).select(
        "conv_id", "turn", "role", "text", F.row_number().over(in_order).cast("long").alias("place"),
        initial.alias("initial"), fault.alias("fault"), F.coalesce(~pair.isin(*LEGAL), F.lit(False)).alias("illegal"))


EDITS = "at long, edit string, place long, new_role string"


def edits_of(marked: DataFrame) -> DataFrame:
    """The cheapest edits of each conversation of ``with_faults``: conv_id, ``at``, edit, ``place`` of the row, new_role.

    Edits are K(eep), R(erole), D(elete) and I(nsert); place is null for an inserted turn; ``at`` orders them and
    counts up to 0. An empty or foreign role fits no place of the grammar, so such a row is reroled or
    deleted. Of equally cheap edits the ASCII-least audit is taken.
    """
    kind = marked.schema["conv_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair, out = Repair(), []
        turns = ((conv, (initial if initial in repair.automaton.terminals else "", fault in ("blank", "duplicate"), fault == "truncated"))
                 for batch in batches for conv, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "initial", "fault"))))

        def written():
            columns = zip(*out)
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [f.name for f in schema])
            out.clear()
            return made

        for conv, own in groupby(turns, key=lambda t: t[0]):
            for back, (edit, turn, role) in enumerate(repair.backward(symbol for _, symbol in own)):
                out.append((conv, -back, edit, None if turn is None else turn + 1, role))
                if len(out) == 1 << 14:
                    yield written()
        if out:
            yield written()

    schema = to_arrow_schema(StructType.fromDDL(f"conv_id {kind}, {EDITS}"))
    types = schema.types
    slim = marked.select("conv_id", "place", "initial", "fault").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return slim.drop("place").mapInArrow(work, f"conv_id {kind}, {EDITS}")


def repaired_turns(marked: DataFrame, edits: DataFrame) -> DataFrame:
    """One row an edit with the turn it makes: conv_id, at, edit, turn, role, text, fault.

    A deleted row keeps its own role and text; an inserted one has an empty text and no turn.
    """
    joined = join_null_safe(edits, marked.select("conv_id", "place", "turn", "role", "text", "fault"), ["conv_id", "place"])
    return joined.select("conv_id", "at", "edit", "turn", F.coalesce("new_role", "role").alias("role"),
                         F.coalesce("text", F.lit("")).alias("text"), "fault")


def edit_cost() -> Column:
    edit = F.col("edit")
    own = F.when(edit == "K", KEEP).when(edit == "R", REROLE).when(edit == "D", DELETE).otherwise(INSERT)
    return own + F.when((edit != "D") & F.col("fault").eqNullSafe("truncated"), TRUNCATED).otherwise(0)


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation of ``repaired_turns``: cost, audit and the SHA-256 of the kept turns' ``role:text`` lines.

    A SHA-256 is worked out from its text's start to its end, so each conversation passes one task in
    order; only the digest's state and the audit are kept.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()

    schema = to_arrow_schema(StructType.fromDDL(f"conv_id {kind}, cost long, audit string, repaired_sha256 string"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        turns = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edit", "paid", "line"))))
        for conv, own in groupby(turns, key=lambda t: t[0]):
            cost, audit, sha, between = 0, bytearray(), hashlib.sha256(), b""
            for _, edit, paid, line in own:
                cost += paid
                audit += edit.encode()
                if line is not None:
                    sha.update(between)
                    sha.update(line)
                    between = b"\n"
            out.append({"conv_id": conv, "cost": cost, "audit": audit.decode(), "repaired_sha256": sha.hexdigest()})
            held += len(audit) + 64
            if held > 1 << 18:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    line = F.when(F.col("edit") != "D", F.concat("role", F.lit(":"), "text").cast("binary"))
    ready = turns.select("conv_id", "at", "edit", edit_cost().cast("long").alias("paid"), line.alias("line"))
    return ready.repartition("conv_id").sortWithinPartitions("conv_id", "at").drop("at").mapInArrow(
        work, f"conv_id {kind}, cost long, audit string, repaired_sha256 string")


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Figures, audit and digest of every conversation; one whose rows are all dropped has zeros."""
    conversations = spark.read.parquet(f"{folder}/conversations.parquet")
    marked = stage(with_faults(damaged(conversations), ("rank",)), "marked-turns")
    found = digests(repaired_turns(marked, edits_of(marked)))

    def counted(kind: str) -> Column:
        return F.count_if(F.col("fault") == kind).alias(kind)

    # distinct turns fold first, so that no task holds a conversation's set of turns
    folded = marked.groupBy("conv_id", "turn").agg(*map(counted, ("blank", "duplicate", "truncated")), F.count_if("illegal").alias("illegal"))
    faults = folded.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
        *(F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal")))
    every = conversations.select("conv_id").distinct()
    out = join_null_safe(join_null_safe(every, faults, ["conv_id"]), found, ["conv_id"])
    none = hashlib.sha256().hexdigest()
    return out.select(
        "conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))


QUERY = op12_conversation_repair
#: The automaton of the grammar by hand (0 start, 1 after s, 2 after u, 3 after a), one turn a recursion; crc32 from its polynomial.
SQL = r"""
with recursive crc as (
  select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
keyed as (
  select conv_id, turn, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as key,
    coalesce(role, ' ') as r0, coalesce(text, ' ') as t0 from conversations),
kinds as (
  select k.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(key) + 1), lambda i: ord(key[i]))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 as kind from keyed k, crc),
rows_after as (
  select conv_id, turn, r0, t0, copy, case when kind = 4 then 'user' else r0 end as role,
    case when kind = 1 then '' when kind = 2 then regexp_replace(t0, '[.!?]', '', 'g') else t0 end as text
  from kinds, (values (0), (1)) c(copy) where kind <> 0 and (copy = 0 or kind = 3)),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, r0, t0, copy) as place,
    row_number() over (partition by conv_id, role, text order by turn nulls first, r0, t0, copy) as seen,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as core, left(role, 1) as initial from rows_after),
marked as (
  select *, case when core = '' then 'blank' when seen > 1 then 'duplicate' when right(core, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
    coalesce(lag(initial) over (partition by conv_id order by place) || initial not in ('su', 'ua', 'au'), false) as illegal from placed),
faults as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
    count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated, count(*) filter (illegal) as illegal
  from marked group by conv_id),
shifts(s, i, e) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
puts(s, e, paid, audit, lines) as (
  select s, s, 0, '', [] from (values (0), (1), (2), (3)) v(s)
  union all select s, e, 5, 'I', [case when i = 'u' then 'user:' else 'assistant:' end] from shifts where i <> 's'
  union all select a.s, b.e, 10, 'II', [case when a.i = 'u' then 'user:' else 'assistant:' end, case when b.i = 'u' then 'user:' else 'assistant:' end]
  from shifts a, shifts b where a.e = b.s and a.i <> 's' and b.i <> 's'),
acts as (
  select conv_id, place, s, e, audit, paid, line from (
    select conv_id, place, s, e, 'K' as audit, if(fault = 'truncated', 5, 0) as paid, role || ':' || text as line
    from marked, shifts where fault not in ('blank', 'duplicate') and initial = i
    union all select conv_id, place, s, e, 'R', 1 + if(fault = 'truncated', 5, 0), if(i = 'u', 'user:', 'assistant:') || text
    from marked, shifts where fault not in ('blank', 'duplicate') and i <> 's'
    union all select conv_id, place, s, s, 'D', 2, null from marked, (values (0), (1), (2), (3)) v(s))),
parse as (
  select conv_id, 0::bigint as place, 0 as state, 0::bigint as cost, '' as audit, []::varchar[] as lines from (select distinct conv_id from marked)
  union all
  select conv_id, place, state, best.cost, best.audit, best.lines from (
    select p.conv_id, a.place, a.e as state,
      min({'cost': p.cost + q.paid + a.paid, 'audit': p.audit || q.audit || a.audit, 'lines': p.lines || q.lines || if(a.line is null, [], [a.line])}) as best
    from parse p join puts q on q.s = p.state join acts a on a.conv_id is not distinct from p.conv_id and a.place = p.place + 1 and a.s = q.e
    group by p.conv_id, a.place, a.e)),
ended as (
  select p.conv_id, min({'cost': p.cost + q.paid, 'audit': p.audit || q.audit, 'lines': p.lines || q.lines}) as best
  from parse p join (select conv_id, max(place) as last from marked group by conv_id) m on m.conv_id is not distinct from p.conv_id and m.last = p.place
  join puts q on q.s = p.state and q.e in (0, 3) group by p.conv_id)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, coalesce(best.cost, 0) as cost, coalesce(best.audit, '') as audit,
  sha256(coalesce(array_to_string(best.lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join faults f on f.conv_id is not distinct from c.conv_id
left join ended e on e.conv_id is not distinct from c.conv_id
"""
