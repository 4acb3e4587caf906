"""Repair of damaged conversations by the cheapest edits.

Each row of a conversation is kept, given another role or deleted, and empty
rows may be inserted, so that roles run ``system? (user assistant)+`` or
nothing is left.  Of equally cheap repairs the one counts whose audit, the
edits' initials in order, is least.

Audits of all states are paths in one tree: a node holds an edit and the
audit before it, so states share what they have in common.  Nodes know their
ancestors at all powers of two and the rolling hash of their path; where two
audits cost the same, these find the longest common prefix in few steps, and
letters along it are compared before it is believed.

Rows come sorted by conversation and turn, and are worked on one at a time.
As soon as all states that can still win agree on the beginning of the audit,
it is written out and its nodes go, so a long conversation needs memory for
what is undecided only, and for its own audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from quillspark.llm.anchors import rows_of
from quillspark.llm.common import position, spread

SPACE = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Where the roles stand: nothing yet, after a system row, after a user row, after an assistant row.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: Roles of empty or changed rows that may come next, with the state after them; a kept system row may only begin.
NEXT = {NONE: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
LEGAL = {"su", "ua", "au"}
_PRIME, _BASE = (1 << 61) - 1, 1_000_003_333_333
#: Rows after which nodes that no state needs any more are looked for.
SWEEP = 64


class Node:
    """An edit at the end of an audit: ``up[k]`` is the node 2**k edits before, ``path`` the hash of all edits so far."""

    __slots__ = ("depth", "edit", "path", "row", "text", "up")

    def __init__(self, parent: Node | None, edit: str, row: int, text: bytes | None):
        self.edit, self.row, self.text = edit, row, text
        self.depth = parent.depth + 1 if parent else 0
        self.path = (parent.path * _BASE + ord(edit)) % _PRIME if parent else 0
        self.up: list[Node] = []
        k, at = 0, parent
        while at is not None:
            self.up.append(at)
            at = at.up[k] if k < len(at.up) else None
            k += 1

    def at_depth(self, depth: int) -> Node:
        node = self
        while node.depth > depth:
            node = node.up[(node.depth - depth).bit_length() - 1]
        return node


def _same(a: Node, b: Node) -> bool:
    """Whether two paths of equal depth and hash are equal, letter by letter down to where they share a node."""
    while a is not b:
        if a.edit != b.edit:
            return False
        a, b = a.up[0], b.up[0]
    return True


def _fork(a: Node, b: Node) -> tuple[Node, Node] | None:
    """First nodes at which the paths of two nodes of equal depth differ; None where they are equal."""
    if a is b or a.path == b.path and _same(a, b):
        return None
    for k in range(len(a.up) - 1, -1, -1):
        if k < len(a.up) and a.up[k] is not b.up[k] and a.up[k].path != b.up[k].path:
            a, b = a.up[k], b.up[k]
    if a.up[0] is not b.up[0] and not _same(a.up[0], b.up[0]):
        # A collision of hashes hid an earlier difference: found letter by letter.
        first, (x, y) = (a, b), (a.up[0], b.up[0])
        while x is not y:
            if x.edit != y.edit:
                first = (x, y)
            x, y = x.up[0], y.up[0]
        return first
    return a, b


def less(a: Node, b: Node) -> bool:
    """Whether the audit that ends at ``a`` comes before the one that ends at ``b``; a beginning comes before the whole."""
    depth = min(a.depth, b.depth)
    fork = _fork(a.at_depth(depth), b.at_depth(depth))
    return a.depth < b.depth if fork is None else fork[0].edit < fork[1].edit


def _common(nodes: list[Node]) -> Node:
    """The last node on the paths of all."""
    least = min(n.depth for n in nodes)
    nodes = [n.at_depth(least) for n in nodes]
    while any(n is not nodes[0] for n in nodes):
        k = len(nodes[0].up) - 1
        while k and all(n.up[k] is nodes[0].up[k] for n in nodes):
            k -= 1
        nodes = [n.up[k] for n in nodes]
    return nodes[0]


class Repair:
    """The running repair of one conversation."""

    def __init__(self):
        self.best: dict[int, tuple[int, Node]] = {NONE: (0, Node(None, "", -1, None))}
        self.audit: list[str] = []
        self.hash, self.begun = hashlib.sha256(), False
        self.turns, self.low, self.high, self.last_turn = 0, None, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = self.rows = 0
        self.before: str | None = None
        self._insert()

    def _offer(self, states: dict, state: int, cost: int, parent: Node, edit: str, text: bytes | None) -> None:
        old = states.get(state)
        if old is not None and old[0] < cost:
            return
        node = Node(parent, edit, self.rows, text)
        if old is None or cost < old[0] or less(node, old[1]):
            states[state] = (cost, node)

    def _insert(self) -> None:
        """Empty rows wherever they make a state cheaper; two in a row suffice, since three are a round and one more."""
        for _ in range(2):
            for state, (cost, node) in list(self.best.items()):
                role, then = NEXT[state]
                self._offer(self.best, then, cost + INSERT, node, "I", f"{role}:".encode())

    def add(self, turn: int | None, role: str, text: str, blank: bool, duplicate: bool, cut: bool) -> None:
        initial = role[:1]
        if self.rows and (self.before or "") + initial not in LEGAL:
            self.illegal += 1
        self.before = initial
        if turn is not None:
            if turn != self.last_turn:
                self.turns, self.last_turn = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
            self.high = turn
        kind = "blank" if blank else "duplicate" if duplicate else "truncated" if cut else None
        if kind:
            setattr(self, kind, getattr(self, kind) + 1)
        states: dict[int, tuple[int, Node]] = {}
        more = TRUNCATED if kind == "truncated" else 0
        own = f"{role}:{text}".encode()
        for state, (cost, node) in self.best.items():
            self._offer(states, state, cost + DELETE, node, "D", None)
            if kind in ("blank", "duplicate"):
                continue
            to, then = NEXT[state]
            if initial == to[0]:
                self._offer(states, then, cost + KEEP + more, node, "K", own)
            if state == NONE and initial == "s":
                self._offer(states, SYSTEM, cost + KEEP + more, node, "K", own)
            if role != to:
                self._offer(states, then, cost + REROLE + more, node, "R", f"{to}:{text}".encode())
        self.best = states
        self._insert()
        self.rows += 1
        # From after an assistant row all goes on as from after a system row, and, once a system row is deleted, as from nothing.
        done = states.get(ASSISTANT)
        if done:
            for state, slack in ((SYSTEM, 0), (NONE, DELETE)):
                if state in states and states[state][0] > done[0] + slack:
                    del states[state]
        if self.rows % SWEEP == 0:
            self._settle()

    def _settle(self) -> None:
        """Writes out what all states agree on and lets go of the nodes before it."""
        root = _common([n for _, n in self.best.values()])
        if root.depth:
            self._write(root)
            # The tail is built anew on a root of its own.
            fresh: dict[int, Node] = {id(root): Node(None, "", root.row, None)}
            before = dict(self.best)
            for state, (cost, node) in before.items():
                chain = []
                while id(node) not in fresh:
                    chain.append(node)
                    node = node.up[0]
                at = fresh[id(node)]
                for old in reversed(chain):
                    at = fresh[id(old)] = Node(at, old.edit, old.row, old.text)
                self.best[state] = (cost, at)

    def _write(self, last: Node) -> None:
        chain = []
        while last.depth:
            chain.append(last)
            last = last.up[0]
        self.audit.append("".join(n.edit for n in reversed(chain)))
        for n in reversed(chain):
            if n.text is not None:
                self.hash.update(b"\n" * self.begun + n.text)
                self.begun = True

    def result(self) -> tuple:
        """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)"""
        ends = [self.best[s] for s in (NONE, ASSISTANT) if s in self.best]
        cost, node = ends[0]
        for c, n in ends[1:]:
            if c < cost or c == cost and less(n, node):
                cost, node = c, n
        self._write(node)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.audit), self.hash.hexdigest()


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> the same after damage, and ``gone`` for rows that are dropped (they stay to tell of their conversation).

    What happens to a row follows from crc32 of ``conv_id:turn``; nulls read as one space.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", said("conv_id"), said("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    out = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


def judged(rows: DataFrame) -> DataFrame:
    """Adds blank, duplicate and cut to the damaged rows, dropped ones aside: no word, seen earlier in the conversation, no end of a sentence."""
    kept = F.rtrim(F.col("text"), F.lit(SPACE))
    key = ["conv_id", "role", "text", "gone"]
    # Only whether a row is the first of its kind matters, so the order of copies does not.
    first = F.row_number().over(W.partitionBy(*key).orderBy(F.asc_nulls_first("turn"), "copy"))
    return rows.withColumn("blank", kept == "").withColumn("duplicate", first > 1).withColumn("cut", ~F.substring(kept, -1, 1).isin(".", "!", "?"))


RESULT = "conv_id {0}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repaired(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", damage: bool = True) -> DataFrame:
    """One row for each conversation: its faults, the cost and audit of its repair and the hash of what comes out.

    Null roles and texts read as one space (a null text is blank), null turns
    come first and count for no gap, rows with a null conversation are one
    conversation.  Rows of one turn are in the order of role and text.  A
    conversation of which no row is left has zeros, an empty audit and the
    hash of the empty text.  Other columns are not looked at.
    """
    name = lambda c: F.col(conversations.columns[position(conversations, c)])
    rows = conversations.select(name(conv_id).alias("conv_id"), name(turn).alias("turn"), name(role).alias("role"), name(text).alias("text"))
    if damage:
        rows = damaged(rows)
    else:
        said: dict[str, Column] = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text")}
        rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), said["role"].alias("role"), said["text"].alias("text"), F.lit(False).alias("gone"), F.lit(1).alias("copy"))
    rows = judged(rows)
    dealt = rows.repartition(spread(rows), "conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "copy")
    kind = conversations.schema[conversations.columns[position(conversations, conv_id)]].dataType

    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, work, done = None, Repair(), []

        def told(key: pa.DataType) -> pa.RecordBatch:
            ids, *numbers, audit, digest = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, key), *[pa.array(c, pa.int64()) for c in numbers], pa.array(audit, pa.string()), pa.array(digest, pa.string())], names=names)

        for b in batches:
            for c, t, r, x, gone, blank, duplicate, cut in rows_of([b]):
                if now != (c,):
                    if now is not None:
                        done.append((*now, *work.result()))
                    now, work = (c,), Repair()
                if not gone:
                    work.add(t, r, x, blank, duplicate, cut)
            if done:
                yield told(b.column(0).type)
                done.clear()
        if now is not None:
            done.append((*now, *work.result()))
            yield told(b.column(0).type)

    return dealt.select("conv_id", "turn", "role", "text", "gone", "blank", "duplicate", "cut").mapInArrow(run, RESULT.format(kind.simpleString()))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    return repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
