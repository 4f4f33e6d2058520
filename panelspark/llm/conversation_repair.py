"""Cheapest repair of conversations: which turns to keep, give another role, delete or insert.

A repaired conversation is empty or an optional system turn followed by pairs of user and assistant.
Roles count by their first character. ``Keep`` costs 0, ``Rerole`` to user or assistant 1,
``Delete`` 2 (required for blank turns and for copies of earlier ones), ``Insert`` of an empty user or
assistant turn 5; a truncated turn that is not deleted adds 5. The audit is the initials of the
cheapest edits in order; of equally cheap ones the least in ASCII order. It decides the repaired
conversation.

The audit programme walks turn by turn over four states (nothing yet, after system, after user,
after assistant). Each state holds a node: last edit, link to the node before, hash of the whole
audit, and links to ancestors at distances of powers of two. Nodes share their beginnings, so a turn costs a
few nodes, not a copy of the audit. Ties are decided at the first edit that differs, found by
comparing hashes of ancestors; what the hashes call equal is verified edit by edit down to a node that both
share.

Work is dealt in two sorts. First the turns' features without their texts are sorted by
(conversation, turn) over ranges, so a conversation may span tasks. A task solves whole conversations
of up to ``PIECE_TURNS``; of a longer one, and of its first and last one, which may go on elsewhere,
it gives pieces: the cheapest audit from each state to each. Then texts are streamed through by
conversation with its pieces ahead, which are joined in order, and hashed as they pass. SHA-256 of a
conversation needs its turns in order in one task; that task holds audits, one character a turn, and no
texts.

Rules: null roles and texts count as one space; in the key of damage so do null ids and turns. Turns
come by number, nulls first, those of one number by role and then by the SHA-256 of their text. Null
ids form one conversation. A conversation without turns, or with nothing left, has an empty audit. An
empty table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import forget, slices

#: Turns that are solved at once; longer conversations are joined from pieces.
PIECE_TURNS = 10_000
#: Costs of the edits.
RELABEL, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_INITIAL = {USER: "u", ASSISTANT: "a"}
_NAME = {USER: "user", ASSISTANT: "assistant"}
_LEGAL = ("su", "ua", "au")

_MODULUS, _BASE = (1 << 61) - 1, 0x1B873593CC9E2D51 % ((1 << 61) - 1)

Best = dict[int, tuple[int, "Node"]]


class Node:
    """The last edit of an audit, and links to where it comes from."""

    __slots__ = ("depth", "edit", "hash", "up")

    def __init__(self, edit: str = "", before: Node | None = None):
        self.edit = edit
        self.depth = before.depth + 1 if before else 0
        self.hash = (before.hash * _BASE + ord(edit)) % _MODULUS if before else 0
        # up[k] is 2**k edits back
        self.up: list[Node] = [before] if before else []
        k = 0
        while before and k < len(self.up[k].up):
            self.up.append(self.up[k].up[k])
            k += 1

    def back(self, n: int) -> Node:
        node, k = self, 0
        while n:
            if n & 1:
                node = node.up[k]
            n >>= 1
            k += 1
        return node

    def audit(self) -> str:
        edits, node = [], self
        while node.up:
            edits.append(node.edit)
            node = node.up[0]
        return "".join(reversed(edits))


def _same(a: Node, b: Node) -> bool:
    """Whether two audits of one length are equal, edit by edit up to a node that both share."""
    while a is not b:
        if a.edit != b.edit:
            return False
        if not a.up:
            return True
        a, b = a.up[0], b.up[0]
    return True


def before(a: Node, b: Node) -> bool:
    """Whether audit ``a`` comes before ``b`` in ASCII order."""
    if a is b:
        return False
    n = min(a.depth, b.depth)
    x, y = a.back(a.depth - n), b.back(b.depth - n)
    if x.hash == y.hash:
        # one begins the other, unless two audits have one hash
        return a.depth < b.depth if _same(x, y) else a.audit() < b.audit()
    for k in range(len(x.up) - 1, -1, -1):
        if k < len(x.up) and x.up[k].hash != y.up[k].hash:
            x, y = x.up[k], y.up[k]
    # x and y are the first pair that differs, if what is before them is equal indeed
    if x.edit == y.edit or not _same(x.up[0], y.up[0]):
        return a.audit() < b.audit()
    return x.edit < y.edit


def _offer(best: Best, state: int, cost: int, edit: str, node: Node) -> None:
    """Enter an edit after ``node`` as the way to a state if it is the best so far."""
    held = best.get(state)
    if held is not None and held[0] < cost:
        return
    made = Node(edit, node)
    if held is None or cost < held[0] or before(made, held[1]):
        best[state] = (cost, made)


def _inserted(best: Best) -> Best:
    """With insertions after the audits; two in a row reach every state that insertions can reach."""
    for _ in range(2):
        for state, (cost, node) in list(best.items()):
            _offer(best, _NEXT[state], cost + INSERT, "I", node)
    return best


def after_turn(best: Best, initial: str, fault: str) -> Best:
    """The best ways to each state after one more turn."""
    best = _inserted(dict(best))
    out: Best = {}
    for state, (cost, node) in best.items():
        _offer(out, state, cost + DELETE, "D", node)
        if fault in ("blank", "duplicate"):
            continue
        cost += TRUNCATED if fault == "truncated" else 0
        to = _NEXT[state]
        if initial == _INITIAL[to]:
            _offer(out, to, cost, "K", node)
        else:
            _offer(out, to, cost + RELABEL, "R", node)
            if initial == "s" and state == START:
                _offer(out, SYSTEM, cost, "K", node)
    return out


@dataclass
class Piece:
    """A run of turns of one conversation in one task."""

    turns: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first_initial: str = ""
    last_initial: str = ""
    first_turn: int | None = None
    least_turn: int | None = None
    last_turn: int | None = None
    distinct: int = 0
    best: dict[int, Best] = field(default_factory=dict)

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        if self.turns and self.last_initial + initial not in _LEGAL:
            self.illegal += 1
        if not self.turns:
            self.first_initial, self.first_turn = initial, turn
        if turn is not None and (self.last_turn is None or turn != self.last_turn):
            self.distinct += 1
        self.last_initial, self.last_turn = initial, turn
        self.least_turn = turn if self.least_turn is None else self.least_turn
        self.turns += 1
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        self.best = {start: after_turn(best, initial, fault) for start, best in self.best.items()}

    def row(self, part: int, number: int) -> tuple:
        ways = [(a, b, cost, node.audit()) for a, best in self.best.items() for b, (cost, node) in _inserted(dict(best)).items()]
        counts = (self.turns, self.blank, self.duplicate, self.truncated, self.illegal)
        return part, number, *counts, self.first_initial, self.last_initial, self.first_turn, self.least_turn, self.last_turn, self.distinct, ways


_WAY = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
_PIECE = {
    "part": ("int", pa.int32()), "number": ("int", pa.int32()), "turns": ("bigint", pa.int64()), "blank": ("bigint", pa.int64()), "duplicate": ("bigint", pa.int64()),
    "truncated": ("bigint", pa.int64()), "illegal": ("bigint", pa.int64()), "first_initial": ("string", pa.string()), "last_initial": ("string", pa.string()),
    "first_turn": ("bigint", pa.int64()), "least_turn": ("bigint", pa.int64()), "last_turn": ("bigint", pa.int64()), "distinct": ("bigint", pa.int64()),
    "ways": ("array<struct<a:int,b:int,cost:bigint,audit:string>>", pa.list_(_WAY)),
}


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, lost): the rows after damage, and lost ones with ``lost`` set."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", spaced(conv), spaced(turn)).cast("binary")) % 20
    emptied = F.when(kind == 1, "").when(kind == 2, F.translate(spaced(text), ".!?", "")).otherwise(spaced(text))
    made = rows.select(
        F.col(conv).alias("conv"), F.col(turn).try_cast("bigint").alias("turn"),
        F.when(kind == 4, "user").otherwise(spaced(role)).alias("role"), emptied.alias("text"),
        (kind == 0).alias("lost"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return made.drop("copy")


def features(turns: DataFrame) -> DataFrame:
    """(conv, turn, role, digest, seq, fault) of turns, without their texts; ``seq`` tells equal turns apart."""
    shown = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    seen = turns.select(
        "conv", "turn", "role", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), F.monotonically_increasing_id().alias("seq"),
        (F.length(shown) == 0).alias("blank"), (~F.right(shown, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )
    seen = cut_lineage(seen)
    told = seen.filter(~F.col("blank"))
    # a turn that is repeated very often is folded where it is read; the join's large keys can be split
    first = told.groupBy(F.col("conv").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest")).agg(F.min(F.struct("turn", "seq"))["seq"].alias("_seq"))
    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    fault = F.when(F.col("seq") != F.col("_seq"), "duplicate").when(F.col("truncated"), "truncated").otherwise("")
    columns = ["conv", "turn", "role", "digest", "seq"]
    return told.join(first, same).select(*columns, fault.alias("fault")).unionByName(seen.filter("blank").select(*columns, F.lit("blank").alias("fault")))


def _part_number() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of sorted turns. Where a conversation surely begins and ends in this task, only its start counts."""
    forget()
    part, number, rows = _part_number(), 0, []
    # the turns of the conversation at hand as (turn, initial, fault); whether it ends here shows when the next begins
    held: list[tuple] = []
    at, whole = None, False

    def solve(whole: bool) -> None:
        nonlocal number, held
        piece = Piece(best={s: {s: (0, Node())} for s in ((START,) if whole else range(4))})
        for turn in held:
            piece.add(*turn)
        rows.append((at, piece.row(part, number)))
        number, held = number + 1, []

    def batch(conv: pa.DataType) -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, (_, k) in zip(zip(*(r for _, r in rows)), _PIECE.values())]
        out = pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], conv), *columns], names=["conv", *_PIECE])
        rows.clear()
        return out

    kind = None
    for arrived in batches:
        kind = arrived.schema.field("conv").type
        for conv, turn, role, fault in zip(*(arrived.column(c).to_pylist() for c in ("conv", "turn", "role", "fault"))):
            if held and conv != at:
                solve(whole)
                whole = True
                if len(rows) >= 1000:
                    yield batch(kind)
            elif len(held) == PIECE_TURNS:
                solve(whole=False)
                whole = False
                yield batch(kind)
            at = conv
            held.append((turn, role[:1], fault))
    if held:
        solve(whole=False)
    if rows:
        yield batch(kind)


def pieces(turns: DataFrame) -> DataFrame:
    """(conv, piece) of all conversations with turns."""
    keys = ["conv", "turn", "role", "digest", "seq"]
    dealt = features(turns).repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv", "turn", "role", "fault")
    found = dealt.mapInArrow(_solve, f"conv {turns.schema['conv'].dataType.simpleString()}, " + ", ".join(f"{k} {t}" for k, (t, _) in _PIECE.items()))
    return found.select("conv", F.struct(*_PIECE).alias("piece"))


#: An audit of several pieces: what comes before, and the last piece's.
Chain = tuple["Chain | None", str]


def _tail_order(a: Chain | None, b: Chain | None) -> tuple[str, str]:
    """The ends of two audits of as many pieces, from where they differ."""
    x, y = [], []
    while a is not b:
        x.append(a[1])
        y.append(b[1])
        a, b = a[0], b[0]
    return "".join(reversed(x)), "".join(reversed(y))


def _text(chain: Chain | None) -> str:
    parts = []
    while chain is not None:
        chain, part = chain
        parts.append(part)
    return "".join(reversed(parts))


class Answer:
    """One conversation from its pieces in order."""

    def __init__(self):
        self.best: dict[int, tuple[int, Chain | None]] = {START: (0, None)}
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.distinct, self.least, self.most, self.last = 0, None, None, None

    @staticmethod
    def _better(a: tuple[int, Chain | None], b: tuple[int, Chain | None] | None) -> bool:
        if b is None or a[0] != b[0]:
            return b is None or a[0] < b[0]
        x, y = _tail_order(a[1], b[1])
        return x < y

    def add(self, piece: dict) -> None:
        for c in self.counts:
            self.counts[c] += piece[c]
        if self.last is not None:
            self.counts["illegal"] += self.last["last_initial"] + piece["first_initial"] not in _LEGAL
            self.distinct -= piece["first_turn"] is not None and piece["first_turn"] == self.last["last_turn"]
        self.distinct += piece["distinct"]
        self.least = piece["least_turn"] if self.least is None else self.least
        self.most = piece["last_turn"] if self.most is None or piece["last_turn"] is not None else self.most
        reached: dict[int, tuple[int, Chain | None]] = {}
        for w in piece["ways"]:
            if w["a"] in self.best:
                cost, chain = self.best[w["a"]]
                way = (cost + w["cost"], (chain, w["audit"]))
                if self._better(way, reached.get(w["b"])):
                    reached[w["b"]] = way
        self.best = reached
        self.last = {k: piece[k] for k in ("last_initial", "last_turn")}

    def row(self) -> dict:
        best = None
        for state in ENDS:
            if state in self.best and self._better(self.best[state], best):
                best = self.best[state]
        gaps = 0 if self.least is None else min(self.most - self.least + 1 - self.distinct, (1 << 63) - 1)
        return {"gaps": gaps, **self.counts, "cost": best[0], "audit": _text(best[1])}


class Repairer:
    """Follows an audit over the turns of a conversation and gives the repaired turns."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _insertions(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = _NEXT[self.state]
            yield _NAME[self.state], ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self._insertions()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return
        self.state = SYSTEM if edit == "K" and role[:1] == "s" else _NEXT[self.state]
        yield (role if edit == "K" else _NAME[self.state]), text

    def end(self) -> Iterator[tuple[str, str]]:
        yield from self._insertions()


_ANSWER = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
_NAMES = [c.split()[0] for c in _ANSWER.split(", ")]


def _streamed(rows: DataFrame) -> DataFrame:
    """Turns and lost rows by conversation, each conversation's pieces first."""
    turns = rows.select("conv", "turn", "role", "text", "lost")
    found = pieces(turns.filter(~F.col("lost")).drop("lost"))
    absent = lambda *columns: [F.lit(None).cast(t).alias(c) for c, t in columns]
    heads = found.select("conv", F.lit(0).alias("kind"), *absent(("turn", "bigint"), ("role", "string"), ("text", "string"), ("digest", "binary"), ("lost", "boolean")), "piece", F.col("piece.part").alias("part"), F.col("piece.number").alias("number"))
    told = lambda c: F.when(~F.col("lost"), c)
    tails = turns.select("conv", F.lit(1).alias("kind"), "turn", told(F.col("role")).alias("role"), told(F.col("text")).alias("text"), told(F.unhex(F.sha2(F.col("text").cast("binary"), 256))).alias("digest"), "lost", *absent(("piece", found.schema["piece"].dataType), ("part", "int"), ("number", "int")))
    order = ["conv", "kind", "part", "number", "turn", "role", "digest"]
    return heads.unionByName(tails).repartition("conv").sortWithinPartitions(*order).select("conv", "kind", "role", "text", "lost", "piece")


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """("turn", conv, role, text) of each repaired turn and ("end", conv, answer) of each conversation."""
    conv, answer, repair = None, None, None

    def opened() -> tuple[dict, Repairer]:
        found = answer.row()
        return found, Repairer(found["audit"])

    def end() -> Iterator[tuple]:
        found, last = repair or opened()
        for turn in last.end():
            yield "turn", conv, *turn
        yield "end", conv, found

    for whole in batches:
        for batch in slices(whole, "text"):
            for row in batch.to_pylist():
                if answer is None or row["conv"] != conv:
                    if answer is not None:
                        yield from end()
                    conv, answer, repair = row["conv"], Answer(), None
                if row["kind"] == 0:
                    answer.add(row["piece"])
                elif not row["lost"]:
                    repair = repair or opened()
                    for turn in repair[1].turn(row["role"], row["text"]):
                        yield "turn", conv, *turn
    if answer is not None:
        yield from end()


def _batches(rows: Iterator[tuple], conv: pa.DataType, columns: list[tuple[str, pa.DataType]], size: int = 1000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    names, kinds = ["conv", *(n for n, _ in columns)], [conv, *(k for _, k in columns)]
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield make()
            held.clear()
    if held:
        yield make()


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv, place, role, text) of the repaired conversations; ``rows`` are those of ``damaged``."""
    conv = _arrow_type(rows, "conv")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        place = 0
        for what, id_, *rest in _events(batches):
            if what == "end":
                place = 0
            else:
                yield id_, place, *rest
                place += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        yield from _batches(placed(batches), conv, [("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    return _streamed(rows).mapInArrow(run, f"conv {rows.schema['conv'].dataType.simpleString()}, place bigint, role string, text string")


def repairs(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``damaged`` rows: faults, cost, audit and ``repaired_sha256``."""
    conv = _arrow_type(rows, "conv")

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        sha, between = hashlib.sha256(), b""
        for what, id_, *rest in _events(batches):
            if what == "end":
                yield id_, *(rest[0][n] for n in _NAMES), sha.hexdigest()
                sha, between = hashlib.sha256(), b""
            else:
                sha.update(between + f"{rest[0]}:{rest[1]}".encode())
                between = b"\n"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        yield from _batches(answered(batches), conv, [*((n, pa.string() if n == "audit" else pa.int64()) for n in _NAMES), ("repaired_sha256", pa.string())])

    return _streamed(rows).mapInArrow(run, f"conv {rows.schema['conv'].dataType.simpleString()}, {_ANSWER}, repaired_sha256 string")
