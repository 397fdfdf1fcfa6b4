"""Conversation structure repair: the cheapest edits that make the turns follow the grammar.

Role initials have to read ``(s?(ua)+)?``.  Cost layers in the manner of Wu and Manber: for
every turn a bitset of grammar states, and for every cost, from 0 up, the states from which
the rest of the conversation can be repaired for that much.  The first layer that accepts at
the start gives the cost; walking through the layers from the start and taking, of the edits
that keep the promise, the first in the order Delete, Insert, Keep, Rerole gives the
ASCII-least audit (each edit of a state has one outcome, so the greedy walk is the least).

Layers times turns grow with the square of a conversation, so a conversation is cut into
segments of ``SEGMENT`` turns.  Behind a segment stands the cost to go of each of the four
states, which a later segment's layers give; so layers never span more than a segment.

Rows are dealt by ranges of (conv_id, turn, role, text), so a conversation of any size is cut
by ranges too.  A task repairs the conversations that lie wholly within its range and are not
long.  Those at a range's border, and long ones, are open: their segments become tables of
costs between states (min-plus matrices), multiplied first within a range, then across ranges
(a row a range), which gives every segment its costs to go.  The last walk over an open
conversation is in order, with one segment in memory: its digest is of the whole text, which
only a sequential pass can give.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt, ship, stored

#: Grammar states: nothing yet, after s, after u, after a.  Where each initial leads.
STATES = 4
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: What Insert and Rerole put in each state, and where that leads (user or assistant).
FILLED = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
#: Whole conversations: nothing at all, or up to an a.
ACCEPTED = (0, 3)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Costs that stand for impossible; no conversation costs as much.
NEVER = 1 << 60
#: Faults of a row.
SOUND, BLANK, DUPLICATE, CUT = 0, 1, 2, 3
#: Turns of a segment; turns and characters that a task holds of one conversation.
SEGMENT, HELD_TURNS, HELD_CHARS = 64, 4096, 4 << 20

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = f"{' long, '.join(COUNTS)} long, audit string, repaired_sha256 string"
RESULT_KINDS = dict.fromkeys(COUNTS, pa.int64()) | {"audit": pa.string(), "repaired_sha256": pa.string()}
LEGAL = ("su", "ua", "au")

Row = tuple  # role, text, fault


def _closure(bits: int) -> int:
    """Bits of the states that an Insert leads into one of bits."""
    return sum(1 << q for q in range(STATES) if bits >> FILLED[q][1] & 1)


def _before(c: str) -> list[int]:
    """For every bitset, the states from which the initial leads into it."""
    return [sum(1 << q for q in range(STATES) if c in NEXT[q] and bits >> NEXT[q][c] & 1) for bits in range(1 << STATES)]


#: The same for Insert and Rerole, and for Keep of each initial.
FILL = [_closure(bits) for bits in range(1 << STATES)]
KEPT = {c: _before(c) for c in "sua"}
NOTHING = [0] * (1 << STATES)


class Layers:
    """reach[c][i]: the states from which the rest after i rows costs at most base + c."""

    def __init__(self, rows: list[tuple[str, int]], to_go: list[int], wanted: int = (1 << STATES) - 1):
        """rows: (initial, fault); to_go: each state's cost behind them; wanted: the states at
        the start that must be found, the possible ones of which end the layers."""
        self.base = min(to_go)
        n = len(rows)
        ends = [x - self.base for x in to_go]
        moves = [(KEPT.get(c, NOTHING), fault) for c, fault in rows]
        latest = max([x for x in ends if x < NEVER // 2], default=0)
        never = [0] * (n + 1)
        self.reach: list[list[int]] = []
        c = 0
        # No row costs more than its deletion, no start more than two insertions.
        while c <= latest + DELETE * n + 2 * INSERT and (c == 0 or self.reach[-1][0] & wanted != wanted):
            one, two, three = (self.reach[c - k] if c >= k else never for k in (1, 2, 3))
            layer = [0] * (n + 1)
            bits = sum(1 << q for q in range(STATES) if ends[q] <= c) | FILL[two[n]]
            layer[n] = bits
            for i in range(n - 1, -1, -1):
                kept, fault = moves[i]
                if fault == SOUND:
                    bits = kept[bits] | FILL[two[i + 1]] | three[i + 1] | FILL[two[i]]
                elif fault == CUT:
                    bits = kept[one[i + 1]] | FILL[three[i + 1]] | three[i + 1] | FILL[two[i]]
                else:
                    bits = three[i + 1] | FILL[two[i]]
                layer[i] = bits
            self.reach.append(layer)
            c += 1

    def cost(self, state: int, at: int = 0) -> int:
        """From the state before row ``at`` to the end; NEVER if there is no way."""
        return next((self.base + c for c, layer in enumerate(self.reach) if layer[at] >> state & 1), NEVER)

    def walk(self, rows: list[tuple[str, int]], state: int, last: bool) -> tuple[list[str], int]:
        """The least edits through the rows from a state, and the state behind them; what is
        inserted behind the last row of a segment is left to the next one unless it is the last."""
        cost = self.cost(state) - self.base
        within = lambda c, i, q: c >= 0 and self.reach[c][i] >> q & 1
        out, i, n = [], 0, len(rows)
        while i < n or last and cost > 0:
            to = FILLED[state][1]
            if i < n and within(cost - DELETE, i + 1, state):
                out.append("D")
                cost, i = cost - DELETE, i + 1
                continue
            if within(cost - INSERT, i, to):
                out.append("I")
                cost, state = cost - INSERT, to
                continue
            initial, fault = rows[i]
            price = TRUNCATED if fault == CUT else 0
            then = NEXT[state].get(initial)
            if then is not None and within(cost - KEEP - price, i + 1, then):
                out.append("K")
                cost, state = cost - KEEP - price, then
            else:
                out.append("R")
                cost, state = cost - REROLE - price, to
            i += 1
        return out, state


def _accepting() -> list[int]:
    return [0 if q in ACCEPTED else NEVER for q in range(STATES)]


def _costs(rows: list[tuple[str, int]], to_go: list[int]) -> list[int]:
    """Each state's cost to go before the rows."""
    layers = Layers(rows, to_go)
    return [layers.cost(q) for q in range(STATES)]


def _between(rows: list[tuple[str, int]]) -> list[int]:
    """Costs from every state before the rows (major) to every state behind them."""
    table = [_costs(rows, [0 if q == end else NEVER for q in range(STATES)]) for end in range(STATES)]
    return [table[end][start] for start in range(STATES) for end in range(STATES)]


def _applied(matrix: list[int], to_go: list[int]) -> list[int]:
    return [min(NEVER, *(matrix[STATES * q + e] + to_go[e] for e in range(STATES))) for q in range(STATES)]


def _product(a: list[int], b: list[int]) -> list[int]:
    return [min(NEVER, *(a[STATES * q + k] + b[STATES * k + e] for k in range(STATES))) for q in range(STATES) for e in range(STATES)]


class Facts:
    """What is counted of a conversation as its rows come by in order."""

    def __init__(self):
        self.first = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial = None

    def add(self, turn: int | None, role: str, fault: int) -> None:
        if turn is not None:
            self.turns += self.first is None or turn != self.turn
            self.first = turn if self.first is None else self.first
            self.turn = turn
        self.blank += fault == BLANK
        self.duplicate += fault == DUPLICATE
        self.truncated += fault == CUT
        self.illegal += self.initial is not None and self.initial + role[:1] not in LEGAL
        self.initial = role[:1]

    def row(self, cost: int, audit: str, digest: str) -> tuple:
        gaps = 0 if self.first is None else self.turn - self.first + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest


class Repaired:
    """The repaired conversation as it is walked: audit, digest, cost."""

    def __init__(self):
        self.audit: list[str] = []
        self.state = self.cost = 0
        self.digest, self.begun = hashlib.sha256(), False

    def _line(self, role: str, text: str) -> None:
        self.digest.update((f"\n{role}:{text}" if self.begun else f"{role}:{text}").encode("utf-8", "replace"))
        self.begun = True

    def segment(self, rows: list[Row], to_go: list[int], last: bool) -> None:
        plain = [(role[:1], fault) for role, _, fault in rows]
        edits, then = Layers(plain, to_go, 1 << self.state).walk(plain, self.state, last)
        i, state = 0, self.state
        for e in edits:
            put, to = FILLED[state]
            if e == "I":
                self._line(put, "")
                self.cost, state = self.cost + INSERT, to
                continue
            role, text, fault = rows[i]
            i += 1
            if e == "D":
                self.cost += DELETE
                continue
            self.cost += (TRUNCATED if fault == CUT else 0) + (REROLE if e == "R" else KEEP)
            self._line(put if e == "R" else role, text)
            state = to if e == "R" else NEXT[state][role[:1]]
        self.audit.append("".join(edits))
        self.state = then


def repaired(rows: list[Row]) -> Repaired:
    """A conversation that is held whole: costs to go from the last segment to the first, then
    the walk from the first to the last."""
    parts = [rows[i : i + SEGMENT] for i in range(0, len(rows), SEGMENT)]
    behind = [_accepting()]
    for p in reversed(parts[1:]):
        behind.append(_costs([(r[:1], f) for r, _, f in p], behind[-1]))
    out = Repaired()
    for k, p in enumerate(parts):
        out.segment(p, behind.pop(), k == len(parts) - 1)
    return out


def _schema(conv: str, more: str) -> str:
    return f"conv_id {conv}, {more}"


def _in_order(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*[c.to_pylist() for c in batch.columns])


def _batch(out: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*out) if out else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))


def row_faults(text: Column) -> Column:
    """BLANK or CUT or SOUND of a row alone; whether it repeats another is seen in order."""
    seen = F.rtrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(seen == "", BLANK).when(F.substring(seen, -1, 1).isin(".", "!", "?"), SOUND).otherwise(CUT)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped: the rows of the stated damage, nulls as one space;
    a dropped row stays as a mark that its conversation exists."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(space("text"), "[.!?]", "")).when(k > 0, space("text"))
    rows = dealt(conversations, "conv_id", "turn", "role", "text").select("conv_id", "turn", F.when(k == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), (k == 0).alias("dropped"), F.when(k == 3, 2).otherwise(1).alias("times"))
    return rows.select("conv_id", "turn", "role", "text", "dropped", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).drop("copy")


def _cut(rows: DataFrame, conv: str) -> DataFrame:
    """Rows in ranges of order -> finished conversations, and the rows of open ones with their
    place (range, number)."""
    nothing = (None,) * len(RESULT_KINDS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        here = TaskContext.get().partitionId()
        kinds: dict[str, pa.DataType] = {}
        out: list[tuple] = []
        held: list[tuple] = []
        size = held_chars = place = 0
        # The first conversation of a range may have begun in the one before.
        opened, conv_id, begun = True, None, False

        def give_open() -> None:
            nonlocal place, held_chars
            for turn, role, text, dropped, fault in held:
                out.append((conv_id, turn, role, text, None if dropped else fault, here, place, *nothing))
                place += 1
            held.clear()
            held_chars = 0

        def finish() -> None:
            nonlocal held_chars
            facts, seen, rows = Facts(), set(), []
            for turn, role, text, dropped, fault in held:
                if dropped:
                    continue
                fault = DUPLICATE if fault != BLANK and (role, text) in seen else fault
                seen.add((role, text))
                facts.add(turn, role, fault)
                rows.append((role, text, fault))
            made = repaired(rows)
            out.append((conv_id, None, None, None, None, None, None, *facts.row(made.cost, "".join(made.audit), made.digest.hexdigest())))
            held.clear()
            held_chars = 0

        for batch in batches:
            kinds = {"conv_id": batch.schema.field("conv_id").type, "turn": batch.schema.field("turn").type, "role": pa.string(), "text": pa.string(), "fault": pa.int32(), "range": pa.int32(), "place": pa.int64()} | RESULT_KINDS
            for conv, turn, role, text, dropped, fault in _in_order(batch):
                if begun and conv != conv_id:
                    give_open() if opened else finish()
                    opened = False
                conv_id, begun = conv, True
                held.append((turn, role, text, dropped, fault))
                held_chars += len(text or "")
                size += len(text or "")
                if opened or len(held) > HELD_TURNS or held_chars > HELD_CHARS:
                    opened = True
                    give_open()
                if size > HELD_CHARS or len(out) > HELD_TURNS:
                    yield _batch(out, kinds)
                    out.clear()
                    size = 0
        # The last one may go on in the next.
        give_open()
        if kinds:
            yield _batch(out, kinds)

    turn = rows.schema["turn"].dataType.simpleString()
    return rows.mapInArrow(work, _schema(conv, f"turn {turn}, role string, text string, fault int, range int, place long, {RESULT}"))


def _costs_to_go(codes: DataFrame, conv: str) -> DataFrame:
    """codes (conv_id, range, place, initial, fault) of open rows -> conv_id, range, segment,
    to_go: each state's cost behind every segment of SEGMENT rows."""
    segments = codes.groupBy("conv_id", "range", F.floor(F.col("place") / SEGMENT).alias("segment")).agg(F.array_sort(F.collect_list(F.struct("place", "initial", "fault"))).alias("rows"))

    @F.pandas_udf("array<long>")
    def between(rows: pd.Series) -> pd.Series:
        return pd.Series([_between([(r["initial"], r["fault"]) for r in x]) for x in rows])

    matrices = stored(segments.select("conv_id", "range", "segment", between("rows").alias("matrix")), "matrices")

    def multiplied(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        total = None
        for m in p.sort_values("segment")["matrix"]:
            total = list(m) if total is None else _product(total, list(m))
        return pd.DataFrame({"conv_id": p["conv_id"].head(1), "range": [key[1]], "matrix": [total]})

    def behind_ranges(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("range", ascending=False)
        to_go, out = _accepting(), []
        for m in p["matrix"]:
            out.append(to_go)
            to_go = _applied(list(m), to_go)
        return pd.DataFrame({"conv_id": p["conv_id"], "range": p["range"], "behind": out})

    def behind_segments(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("segment", ascending=False)
        out, to_go = [], list(p["behind"].iat[0]) if len(p) else []
        for m in p["matrix"]:
            out.append(to_go)
            to_go = _applied(list(m), to_go)
        return pd.DataFrame({"conv_id": p["conv_id"], "range": p["range"], "segment": p["segment"], "to_go": out})

    ranges = matrices.groupBy("conv_id", "range").applyInPandas(multiplied, _schema(conv, "range int, matrix array<long>"))
    behind = ranges.groupBy("conv_id").applyInPandas(behind_ranges, _schema(conv, "range int, behind array<long>"))
    same = F.col("m.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("m.range") == F.col("b.range"))
    both = matrices.alias("m").join(behind.alias("b"), same).select("m.*", "b.behind")
    return both.groupBy("conv_id", "range").applyInPandas(behind_segments, _schema(conv, "range int, segment long, to_go array<long>"))


def _walked(rows: DataFrame, conv: str) -> DataFrame:
    """Open rows in order, with the costs to go of their segments -> finished conversations;
    one segment is in memory at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: dict[str, pa.DataType] = {}
        out: list[tuple] = []
        part: list[Row] = []
        conv_id = key = to_go = None
        begun = False
        facts, made = Facts(), Repaired()

        def end() -> None:
            nonlocal part, facts, made
            if part:
                made.segment(part, to_go, True)
            out.append((conv_id, *facts.row(made.cost, "".join(made.audit), made.digest.hexdigest())))
            part, facts, made = [], Facts(), Repaired()

        for batch in batches:
            kinds = {"conv_id": batch.schema.field("conv_id").type} | RESULT_KINDS
            for conv, at, segment, turn, role, text, fault, behind in _in_order(batch):
                if begun and conv != conv_id:
                    end()
                    key = None
                    if len(out) > HELD_TURNS:
                        yield _batch(out, kinds)
                        out.clear()
                conv_id, begun = conv, True
                if fault is None:
                    continue
                if key is not None and key != (at, segment):
                    made.segment(part, to_go, False)
                    part = []
                key, to_go = (at, segment), behind
                facts.add(turn, role, fault)
                part.append((role, text, fault))
        if begun:
            end()
            yield _batch(out, kinds)

    return rows.mapInArrow(work, _schema(conv, RESULT))


def repair_turns(rows: DataFrame) -> DataFrame:
    """The cheapest repair of every conversation, one row a conversation.

    rows: conv_id, turn, role, text, dropped (as damaged() gives; a row with dropped set only
    says that its conversation exists).  Rows are taken by turn (nulls first), then role, then
    text, both by their bytes.  Returns conv_id, gaps, blank, duplicate, truncated, illegal,
    cost (long), audit, repaired_sha256.

    A null conv_id is a conversation of its own; conversations without a row count zeros, an
    empty audit and the digest of nothing; equal rows of a turn stand side by side, the second
    one a duplicate; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    ship(spark)
    conv = rows.schema["conv_id"].dataType.simpleString()
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["conv_id", "turn", "role", "text"]
    sorted_rows = rows.select(*order, "dropped", F.when(~F.col("dropped"), row_faults(F.col("text"))).alias("fault")).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    cut = stored(_cut(sorted_rows, conv), "turns")
    names = list(RESULT_KINDS)
    done = cut.where("range is null").select("conv_id", *names)
    opened = cut.where("range is not null").select("conv_id", "turn", "role", "text", "fault", "range", "place", F.sha2(F.concat_ws("\n", "role", "text"), 256).alias("digest"))
    # The first of equal rows is none: where a digest occurs once, nothing is to be marked.
    live = opened.where("fault is not null")
    first = live.groupBy("conv_id", F.length("role").alias("r"), "digest").agg(F.min(F.struct("range", "place")).alias("first"), F.count("*").alias("k")).where("k > 1")
    same = F.col("o.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.length("o.role") == F.col("f.r")) & (F.col("o.digest") == F.col("f.digest"))
    repeats = F.coalesce(F.struct("o.range", "o.place") > F.col("f.first"), F.lit(False)) & (F.col("o.fault") != BLANK)
    marked = opened.alias("o").join(first.alias("f"), same, "left").select("o.conv_id", "o.range", "o.place", "o.turn", "o.role", "o.text", F.when(repeats, DUPLICATE).otherwise(F.col("o.fault")).alias("fault"), F.floor(F.col("o.place") / SEGMENT).alias("segment"))
    marked = stored(marked, "open-turns")
    codes = marked.where("fault is not null").select("conv_id", "range", "place", F.substring("role", 1, 1).alias("initial"), "fault")
    to_go = _costs_to_go(codes, conv)
    at = F.col("o.conv_id").eqNullSafe(F.col("g.conv_id")) & (F.col("o.range") == F.col("g.range")) & (F.col("o.segment") == F.col("g.segment"))
    given = marked.alias("o").join(to_go.alias("g"), at, "left").select("o.conv_id", "o.range", "o.segment", "o.place", "o.turn", "o.role", "o.text", "o.fault", "g.to_go")
    walk = given.repartition(ranges, "conv_id").sortWithinPartitions("conv_id", "range", "place").select("conv_id", "range", "segment", "turn", "role", "text", "fault", "to_go")
    return done.union(_walked(walk, conv))


def conversation_repair(conversations: DataFrame) -> DataFrame:
    """The stated query: conversations (conv_id, turn, role, text; other columns are ignored)
    after the stated damage, repaired."""
    return repair_turns(damaged(conversations))
