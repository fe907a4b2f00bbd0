"""Conversations repaired by the cheapest edits: a min-plus matrix scan.

A turn is a 4x4 matrix over (cost, audit): from what the roles so far end with to what they then end with, with any insertions
ahead of the turn. Sums of costs and joined audits multiply, the least multiply's result adds, so the product is associative: a
conversation is reduced in as many runs as it has partitions, and the runs' matrices by a tree. Of two audits of equal cost
neither begins the other, as what is longer inserts more, so the least by cost and text stays least whatever follows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, checkpointed

#: Costs of edits: fixed values. A truncated turn that isn't deleted costs UNFIXED more.
KEEP, REROLE, DELETE, INSERT, UNFIXED = 0, 3, 4, 3, 3
#: What roles so far end with: nothing, system, user, assistant; where each state goes on, by the next role's initial.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ENDS, LEGAL = (START, ASSISTANT), ("su", "ua", "au")
#: The role that an insertion or a new role gives, by state.
GIVEN = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Runs of a conversation that one step of the tree joins; turns that a batch of results has.
FAN, OUT = 8, 4096

Matrix = list[tuple[int, str] | None]  # row by row; None: no way


def times(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = []
    for i in range(0, 16, 4):
        for j in range(4):
            ways = [(x[0] + y[0], x[1] + y[1]) for k in range(4) if (x := a[i + k]) is not None and (y := b[4 * k + j]) is not None]
            out.append(min(ways, default=None))
    return out


ONE: Matrix = [(0, "") if i % 5 == 0 else None for i in range(16)]


@cache
def insertions() -> tuple:
    """Any number of inserted turns: two of them lead back, so one or two are enough."""
    step: Matrix = [None] * 16
    for state, role in GIVEN.items():
        step[4 * state + NEXT[state][role[0]]] = (INSERT, "I")
    ways = [ONE, step, times(step, step)]
    return tuple(min([w[i] for w in ways if w[i] is not None], default=None) for i in range(16))


@cache
def turn_matrix(initial: str, fault: int) -> tuple:
    own: Matrix = [(DELETE, "D") if i % 5 == 0 else None for i in range(16)]
    if fault not in (BLANK, DUPLICATE):
        more = UNFIXED if fault == TRUNCATED else 0
        for state, role in GIVEN.items():
            own[4 * state + NEXT[state][role[0]]] = (REROLE + more, "R")
            if initial in NEXT[state]:
                own[4 * state + NEXT[state][initial]] = (KEEP + more, "K")
    return tuple(times(list(insertions()), own))


class Run:
    """Turns that follow each other: counts, what a neighbour needs to know, and the product of their matrices."""

    FIELDS = ("blank", "duplicate", "truncated", "illegal", "first", "last", "lowest", "highest", "turns")

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.lowest = self.highest = None
        self.products: list[tuple[int, Matrix]] = []  # of 2 to the power of n turns or runs each, the larger ones first

    def _multiply(self, size: int, m: Matrix) -> None:
        while self.products and self.products[-1][0] <= size:
            before, own = self.products.pop()
            size, m = size + before, times(own, m)
        self.products.append((size, m))

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        self.blank += fault == BLANK
        self.duplicate += fault == DUPLICATE
        self.truncated += fault == TRUNCATED
        self._meet(initial, initial, turn, turn, int(turn is not None))
        self._multiply(1, turn_matrix(initial, fault))

    def _meet(self, first: str, last: str, lowest: int | None, highest: int | None, turns: int) -> None:
        self.illegal += self.last is not None and self.last + first not in LEGAL
        self.first = first if self.first is None else self.first
        self.last = last
        if turns:
            self.turns += turns - (self.highest == lowest)
            self.lowest = lowest if self.lowest is None else self.lowest
            self.highest = highest

    def join(self, row: dict) -> None:
        """Goes on with a later run."""
        for c in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, c, getattr(self, c) + row[c])
        if row["first"] is not None:
            self._meet(row["first"], row["last"], row["lowest"], row["highest"], row["turns"])
        self._multiply(1, [None if c is None else (c, a) for c, a in zip(row["costs"], row["audits"])])

    def product(self) -> Matrix:
        out: Matrix = ONE
        for _, m in self.products:
            out = times(out, m)
        return out

    def row(self) -> dict:
        m = self.product()
        return {c: getattr(self, c) for c in self.FIELDS} | {"costs": [x and x[0] for x in m], "audits": [x and x[1] for x in m]}


RUN = "blank long, duplicate long, truncated long, illegal long, first string, last string, lowest long, highest long, turns long, costs array<long>, audits array<string>"
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def skeletons(turns: DataFrame) -> DataFrame:
    """turns without texts, equal ones as one row: conv_id, turn, initial (of the role), fault, n (of them), seen (the first isn't the first of its role and text)."""
    last = F.regexp_extract("text", rf"([^\x20\x09-\x0D]){SPACE}*\z", 1)
    own = F.when(last == "", BLANK).when(last.isin(".", "!", "?"), FINE).otherwise(TRUNCATED).alias("fault")
    rows = turns.select("conv_id", "turn", "role", F.unhex(F.md5("text")).alias("hash"), own, "copies")
    rows = rows.groupBy("conv_id", "turn", "role", "hash").agg(F.max("fault").alias("fault"), F.sum("copies").alias("n"))
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    several = rows.where("n > 0").groupBy("conv_id", "role", "hash").agg(F.count(F.lit(1)).alias("m"), F.min(when).alias("_first")).where("m > 1")
    several = several.select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("hash").alias("_hash"), "_first")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("hash") == F.col("_hash"))
    return rows.join(several, same, "left").select("conv_id", "turn", "role", "hash", F.substring("role", 1, 1).alias("initial"), "fault", "n", F.coalesce(when > F.col("_first"), F.lit(False)).alias("seen"))


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _types(conv: pa.DataType, ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([("conv_id", conv), *((n, kinds[k]) for n, k in (x.split() for x in ddl.split(", ")))])


def runs(turns: DataFrame) -> DataFrame:
    """A row for each run of a conversation's turns that one partition has; `edge` where the conversation may go on in another.

    Skeletons are dealt by ranges of (conversation, turn), which split a conversation of any length."""
    own, ddl = skeletons(turns), f"part int, edge boolean, {RUN}"
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "hash")]
    ranged = own.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, schema, done, number = None, None, None, [], 0
        for b in batches:
            schema = schema or _types(b.schema.field("conv_id").type, ddl)
            for conv, turn, initial, fault, n, seen, part in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault", "n", "seen", "part"))):
                if now is None or conv != at:
                    if now is not None:
                        done.append({"conv_id": at, "part": part, "edge": number == 0} | now.row())
                        number += 1
                        if len(done) == OUT:
                            yield _batch(done, schema)
                            done = []
                    now, at = Run(), conv
                for k in range(n):
                    now.add(turn, initial, DUPLICATE if fault != BLANK and (seen or k) else fault)
        if now is not None:
            yield _batch([*done, {"conv_id": at, "part": part, "edge": True} | now.row()], schema)

    return ranged.mapInArrow(run, f"conv_id {dict(turns.dtypes)['conv_id']}, {ddl}")


def _joined(edges: DataFrame) -> DataFrame:
    """Runs of the same conversation as one, by a tree of FAN at a time."""
    ddl = f"part int, edge boolean, {RUN}"

    def join(group: pa.Table) -> pa.Table:
        rows, out = sorted(group.to_pylist(), key=lambda r: r["part"]), Run()
        for r in rows:
            out.join(r)
        return pa.Table.from_batches([_batch([{"conv_id": rows[0]["conv_id"], "part": rows[0]["part"] // FAN, "edge": True} | out.row()], _types(group.schema.field("conv_id").type, ddl))])

    left = edges.agg(F.max("part")).first()[0] or 0
    while left or left is not None:
        edges = edges.withColumn("step", F.expr(f"part div {FAN}")).groupBy("conv_id", "step").applyInArrow(lambda t: join(t.drop_columns(["step"])), f"conv_id {dict(edges.dtypes)['conv_id']}, {ddl}")
        left = left // FAN or None
    return edges


def repair_plan(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of each conversation of turns (conv_id, turn, role, text, copies)."""
    all_runs = checkpointed(runs(turns))
    whole = all_runs.where("not edge").unionByName(_joined(all_runs.where("edge")))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                m = [None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"])]
                cost, audit = min(x for j in ENDS if (x := times(m, list(insertions()))[j]) is not None)
                gaps = r["highest"] - r["lowest"] + 1 - r["turns"] if r["turns"] else 0
                rows.append({c: r[c] for c in ("conv_id", "blank", "duplicate", "truncated", "illegal")} | {"gaps": gaps, "cost": cost, "audit": audit})
            yield _batch(rows, _types(b.schema.field("conv_id").type, REPORT))

    return whole.mapInArrow(close, f"conv_id {dict(turns.dtypes)['conv_id']}, {REPORT}")


def _stream(turns: DataFrame, plan: DataFrame) -> DataFrame:
    """What a task reads to repair its conversations: of each the plan, then its turns in order, through Spark's external sort."""
    texts = turns.where("copies > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role", F.unhex(F.md5("text")).alias("hash"), "text", "copies")
    first = plan.select("conv_id", F.lit(0).alias("kind"), F.struct(*[c for c in plan.columns if c != "conv_id"]).alias("plan"))
    order = [F.asc_nulls_first(c) for c in ("conv_id", "kind", "turn", "role", "hash")]
    return texts.unionByName(first, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions(*order)


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, plan, None) where a conversation starts, and (role, text) of each of its repaired turns."""
    audit, at, state = "", 0, START

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            yield GIVEN[state], ""
            at, state = at + 1, NEXT[state][GIVEN[state][0]]

    for b in batches:
        for conv, kind, role, text, copies, plan in zip(*(b.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text", "copies", "plan"))):
            if kind == 0:
                yield from inserted()
                audit, at, state = plan["audit"], 0, START
                yield conv, plan, None
                continue
            for _ in range(copies):
                yield from inserted()
                edit, at = audit[at], at + 1
                if edit != "D":
                    own = role if edit == "K" else GIVEN[state]
                    state = NEXT[state][own[0]]
                    yield own, text
    yield from inserted()


def _mapped(df: DataFrame, ddl: str, rows: Callable[[Iterator[tuple]], Iterator[dict]]) -> DataFrame:
    conv = dict(df.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema, held = _types(first.schema.field("conv_id").type, ddl), []
        for r in rows(_events(x for y in ([first], batches) for x in y)):
            held.append(r)
            if len(held) == OUT:
                yield _batch(held, schema)
                held = []
        yield _batch(held, schema)

    return df.mapInArrow(run, f"conv_id {conv}, {ddl}")


def repaired_turns(turns: DataFrame, plan: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role and text of the repaired conversations: of turns and their repair_plan."""

    def rows(events: Iterator[tuple]) -> Iterator[dict]:
        conv, place = None, 0
        for e in events:
            if len(e) == 3:
                conv, place = e[0], 0
            else:
                yield {"conv_id": conv, "place": place, "role": e[0], "text": e[1]}
                place += 1

    return _mapped(_stream(turns, plan), "place long, role string, text string", rows)


def repair_report(turns: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """The repair_plan, and repaired_sha256: of the repaired conversation's lines `role:text`.

    turns: (conv_id, turn, role, text, copies): a row stands for `copies` equal turns, with 0 for none, so that its
    conversation is known. Turns go by `turn`, nulls first; those of the same one by role, then by a hash of their text; equal
    rows follow each other, so all but the first are duplicates. A null conv_id is a conversation like any other. Roles and texts
    are not null here (see given_turns). A conversation without turns costs nothing and has an empty audit. Other columns,
    whatever their names, don't matter; an empty table gives an empty result.

    A conversation of any length is planned in parts, without its texts. Its digest is one sequence by its nature: the task
    that has the conversation reads its turns as a sorted stream and holds its audit and one batch of them.
    """

    def rows(events: Iterator[tuple]) -> Iterator[dict]:
        now, sha, some = None, hashlib.sha256(), False
        for e in events:
            if len(e) == 3:
                if now is not None:
                    yield now | {"repaired_sha256": sha.hexdigest()}
                now, sha, some = {"conv_id": e[0]} | e[1], hashlib.sha256(), False
            else:
                sha.update(f"{chr(10) * some}{e[0]}:{e[1]}".encode())
                some = True
        if now is not None:
            yield now | {"repaired_sha256": sha.hexdigest()}

    return _mapped(_stream(turns, repair_plan(turns) if plan is None else plan), f"{REPORT}, repaired_sha256 string", rows)


def given_turns(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) as turns: a null role or text is one space."""
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], F.lit(1).alias("copies"))


def damaged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) as turns with faults, by a hash of their place: fixed rules of op12's contract."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    code: Column = F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20
    own = given_turns(rows).select("*", code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1).alias("copies"))
