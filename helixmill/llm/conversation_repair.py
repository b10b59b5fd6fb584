"""Conversation structure repair: cheapest edits that give a legal order of roles, by a Viterbi search with survivor coalescence.

Roles must read `(s?(ua)+)?`: nothing, or pairs of user and assistant behind at most one system turn. A search state is what
the turns kept so far end with (nothing, s, u, a), so at most four survivors are alive. Each is a leaf of a tree of
backpointers that counts references: a node that no survivor leads to goes, and what all survivors have in common is
decided, so it is sent on at once with its rows. Only the unresolved ends stay in memory, not the conversation.

Equally cheap survivors are compared over their whole unresolved ends: the order of all survivors' edits is kept as ranks,
which a step extends by the letters it adds. Edits of equal cost over the same rows are never a prefix of each other (a
row's cost depends on its letter alone), so the smaller one stays smaller whatever follows.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixmill.llm.common import table

#: Costs of the edits, white space, marks that end a text.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
WHITE = " \t\n\v\f\r"
STOPS = ".!?"
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: States from which a user's, an assistant's turn may follow.
BEFORE = {USER: (EMPTY, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
#: Edits as bytes: delete, keep, rerole to user or assistant, insert user or assistant; and the letters that stand for them.
TO = {USER: (b"u", b"U"), ASSISTANT: (b"a", b"A")}
LETTER = {ord("D"): "D", ord("K"): "K", ord("u"): "R", ord("a"): "R", ord("U"): "I", ord("A"): "I"}
LETTERS = bytes.maketrans(b"uaUA", b"RRII")
ROLE = {ord("u"): "user", ord("a"): "assistant", ord("U"): "user", ord("A"): "assistant"}


class Node:
    """A stretch of edits in the tree of backpointers; its references are its kids and, at a leaf, a survivor."""

    __slots__ = ("parent", "kids", "edits")

    def __init__(self, parent: Node | None, edits: bytes = b""):
        self.parent, self.kids, self.edits = parent, [], bytearray(edits)


class Repair:
    """The search over one conversation: `step` takes a row and gives the edits that are then decided, `end` the rest."""

    def __init__(self):
        self.root = Node(None)
        self.alive: list[tuple[int, int, Node] | None] = [(0, 0, self.root), None, None, None]  # cost, rank, leaf

    def with_inserts(self) -> list[tuple[int, int, bytes, Node] | None]:
        """The survivors (cost, rank, inserts, leaf) by state, inserts included."""
        out = [x and (x[0], x[1], b"", x[2]) for x in self.alive]
        for to in (USER, ASSISTANT, USER):
            for at in BEFORE[to]:
                if (x := out[at]) and (out[to] is None or (x[0] + INSERT, x[1]) < out[to][:2]):
                    out[to] = (x[0] + INSERT, x[1], x[2] + TO[to][1], x[3])
        a = out[ASSISTANT]  # whatever follows costs no more from here than from s, and at most a delete more than from nothing
        if out[EMPTY] and out[EMPTY][0] > a[0] + DELETE:
            out[EMPTY] = None
        if out[SYSTEM] and out[SYSTEM][0] > a[0]:
            out[SYSTEM] = None
        return out

    def step(self, initial: str, fault: str | None) -> bytes:
        """Edits that all survivors share after a row whose role begins with `initial`."""
        at = self.with_inserts()
        best: list[tuple[int, int, bytes, bytes, Node] | None] = [None] * 4

        def offer(to: int, x, cost: int, edit: bytes) -> None:
            edits = x[2] + edit
            new = (x[0] + cost, x[1], edits.translate(LETTERS), edits, x[3])
            if best[to] is None or new[:3] < best[to][:3]:
                best[to] = new

        for to, x in enumerate(at):
            if x:
                offer(to, x, DELETE, b"D")
        if fault not in ("blank", "duplicate"):
            more = TRUNCATED if fault == "truncated" else 0
            if initial == "s" and at[EMPTY]:
                offer(SYSTEM, at[EMPTY], more, b"K")
            for to, own in ((USER, "u"), (ASSISTANT, "a")):
                for before in BEFORE[to]:
                    if x := at[before]:
                        if initial == own:
                            offer(to, x, more, b"K")
                        else:
                            offer(to, x, REROLE + more, TO[to][0])
        order = sorted({x[1:3] for x in best if x})
        self._extend([x and (x[0], order.index(x[1:3]), x[3], x[4]) for x in best])
        return self._decided()

    def _extend(self, chosen: list[tuple[int, int, bytes, Node] | None]) -> None:
        """Puts the new survivors below the old ones and lets go of the leaves that none has chosen."""
        uses: dict[int, int] = {}
        for x in chosen:
            if x:
                uses[id(x[3])] = uses.get(id(x[3]), 0) + 1
        old = {id(x[2]): x[2] for x in self.alive if x}
        self.alive = [None] * 4
        for i, x in enumerate(chosen):
            if x is None:
                continue
            cost, rank, edits, leaf = x
            if uses[id(leaf)] == 1:
                leaf.edits += edits
            else:
                kid = Node(leaf, edits)
                leaf.kids.append(kid)
                leaf = kid
            self.alive[i] = (cost, rank, leaf)
        thinned = [self._release(leaf) for key, leaf in old.items() if key not in uses]
        for node in thinned:
            if node is not None and node is not self.root and len(node.kids) == 1 and node.kids[0].parent is node:
                self._join(node)

    def _release(self, node: Node) -> Node | None:
        """Takes away a leaf and all above it that lead nowhere else; the node where it branched off."""
        while (up := node.parent) is not None:
            up.kids.remove(node)
            if up.kids:
                return up
            node = up

    def _join(self, node: Node) -> None:
        """One kid left: its edits go to the node, which takes its place."""
        kid = node.kids[0]
        node.edits += kid.edits
        node.kids = kid.kids
        for x in node.kids:
            x.parent = node
        self.alive = [x and (x[0], x[1], node if x[2] is kid else x[2]) for x in self.alive]

    def _decided(self) -> bytes:
        """The edits of the root, as long as all survivors stand below it."""
        out = bytes(self.root.edits)
        self.root.edits.clear()
        while len(self.root.kids) == 1:
            self.root = self.root.kids[0]
            self.root.parent = None
            out += self.root.edits
            self.root.edits.clear()
        return out

    def unresolved(self) -> int:
        """Edits held in the tree."""
        held, todo = 0, [self.root]
        while todo:
            node = todo.pop()
            held += len(node.edits)
            todo += node.kids
        return held

    def end(self) -> tuple[int, bytes]:
        """The least cost, and the edits that are not decided yet, of the cheapest legal end (ASCII-least on ties)."""
        cost, _, inserts, node = min((x for i, x in enumerate(self.with_inserts()) if x and i in (EMPTY, ASSISTANT)), key=lambda x: x[:2])
        parts = [inserts]
        while node is not None:
            parts.append(bytes(node.edits))
            node = node.parent
        return cost, b"".join(reversed(parts))


def repairs(batches: Iterator[pa.RecordBatch], rows: int = 5_000, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Rows (conv, turn, role, text, fault), conversations together and in order, as rows of edits, at most `most` characters of text a batch."""
    out: list[tuple] = []
    held, any_, conv, search, waiting, place = 0, False, None, Repair(), deque(), 0

    def put(edits: bytes) -> None:
        nonlocal held, place
        for e in edits:
            turn, role, text, fault = (None, None, "", None) if e in b"UA" else waiting.popleft()
            new = role if e in b"DK" else ROLE[e]
            out.append((conv, place, LETTER[e], turn, role, new, text, fault))
            held += len(text)
            place += 1

    def flush() -> pa.RecordBatch:
        nonlocal out, held
        names = ["conv", "place", "edit", "turn", "was", "role", "text", "fault"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.large_string(), pa.string()]
        cols = list(zip(*out)) or [()] * len(names)
        out, held = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t).cast(pa.string() if t == pa.large_string() else t) for c, t in zip(cols, types)], names)

    for batch in batches:
        for c, *row in zip(*(batch.column(x).to_pylist() for x in ("conv", "turn", "role", "text", "fault"))):
            if any_ and c != conv:
                put(search.end()[1])
                search, place = Repair(), 0
            any_, conv = True, c
            waiting.append(row)
            put(search.step(row[1][:1], row[3]))
            if len(out) >= rows or held >= most:
                yield flush()
    if any_:
        put(search.end()[1])
    yield flush()


def repair_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The cheapest edits of each conversation, a row an edit: conv, place (from 0), edit, turn, was, role, text, fault.

    A conversation's rows stand by turn, null first, then by role and text. Edits: K keeps a row, R gives it the role user or
    assistant (3), D deletes it (4), I puts in an empty turn of the user or assistant (3); an undeleted truncated row costs 3
    more. `role` is the role after the edit, `was` before it (null for I), of which the first character counts; `fault` is the
    first of blank (no character but ASCII white space; deleted), duplicate (role and text stood before in the conversation;
    deleted) and truncated (does not end with . ! or ?). Of equally cheap edits the ASCII-least letters win.

    Null roles and texts are one space; null conversations are one conversation. Repeated rows are duplicates. Other columns
    are dropped whatever their names. An empty table gives an empty result. Rows come sorted within the partitions.

    A conversation's rows are sorted (on disk if need be) and read by one task, since each edit depends on all before it; the
    task holds a batch and the unresolved end of the conversation.
    """
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = turns.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"))
    rest = F.rtrim(F.col("text"), F.lit(WHITE))
    nth = F.row_number().over(Window.partitionBy("conv", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    fault = F.when(rest == "", "blank").when(nth > 1, "duplicate").when(~F.substring(rest, -1, 1).isin(*STOPS), "truncated")
    dealt = own.repartition(n, "conv").withColumn("fault", fault).sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text", F.col("fault").isin("duplicate").asc())
    return dealt.mapInArrow(repairs, "conv long, place long, edit string, turn long, was string, role string, text string, fault string")


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of conversations (nulls: one space) damaged by crc32(`conv_id:turn`) % 20, with `gone` for those that are dropped."""
    words = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(words["conv_id"], F.lit(":"), words["turn"]).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(words["text"], STOPS, "")).otherwise(words["text"])
    role = F.when(kind == 4, "user").otherwise(words["role"])
    own = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("_kind"))
    return own.select("conv_id", "turn", "role", "text", (F.col("_kind") == 0).alias("gone"), F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("col")


def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of edits, conversations together and in order, as a row a conversation."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    cost = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}
    out, any_, conv = [], False, None

    def start() -> None:
        nonlocal counts, first, last, turns, before, total, illegal, audit, sha, some
        counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        first = last = before = None
        turns = total = illegal = 0
        audit, sha, some = bytearray(), hashlib.sha256(), False

    counts = first = last = turns = before = total = illegal = audit = sha = some = None

    def close() -> None:
        gaps = last - first + 1 - turns if turns else 0
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, total, audit.decode(), sha.hexdigest()))

    def flush() -> pa.RecordBatch:
        nonlocal out
        cols = list(zip(*out)) or [()] * len(names)
        out = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k > 6 else pa.int64()) for k, c in enumerate(cols)], names)

    for batch in batches:
        for c, edit, turn, was, role, text, fault in zip(*(batch.column(x).to_pylist() for x in ("conv", "edit", "turn", "was", "role", "text", "fault"))):
            if not any_ or c != conv:
                if any_:
                    close()
                any_, conv = True, c
                start()
            audit += edit.encode()
            total += cost[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
            if was is not None:
                if fault:
                    counts[fault] += 1
                if before is not None and before + was[:1] not in ("su", "ua", "au"):
                    illegal += 1
                before = was[:1]
                if turn is not None and turn != last:
                    first, last, turns = turn if first is None else first, turn, turns + 1
            if edit != "D":
                sha.update(f"{chr(10) if some else ''}{role}:{text}".encode())
                some = True
        if len(out) >= 1_000:
            yield flush()
    if any_:
        close()
    yield flush()


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a conversation; conversations without a row after the damage have zeros and the hash of nothing."""
    rows = damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    found = repair_conversations(rows.where(~F.col("gone"))).mapInArrow(digests, schema)
    none = rows.groupBy("conv_id").agg(F.min("gone").alias("none")).where("none").select(F.col("conv_id").cast("long"), *(F.lit(0).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("repaired_sha256"))
    return found.unionByName(none)
