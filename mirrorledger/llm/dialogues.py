"""Conversation structure repair: the cheapest edits that make a conversation an optional system turn and user/assistant pairs.

Each row is kept (cost 0), given the role user or assistant (3) or deleted (4; blank and repeated rows must be), and empty
user or assistant turns may be inserted anywhere (3). A truncated row that stays adds 3. The role initials that remain must
be ``(s?(ua)+)?``. The edits' initials in order are the audit; of equally cheap audits the ASCII-least one is taken.

This is a shortest path in a directed acyclic graph whose nodes are (rows taken, inserted turns since, state of the
pattern). An edge's weight is one integer: its high digits are the cost, and its low digits are in base 5 the audit's
letters (D 1, I 2, K 3, R 4), each at its own place of a fixed width and zero where the audit has ended, so that the
smaller integer is the cheaper or else the ASCII-lesser path. Every ``BLOCK`` rows the letters are written off: of the at
most four paths alive only their order matters from then on, and it takes one digit between cost and letters. Two of these
paths never have one audit begin with the other (each ends with a row's letter), so this loses nothing, and integers stay
short in a conversation of any length.

Rows pass in order, sorted by Spark; a task holds the four paths with their letters and the running digest of each, but
no rows. So a conversation with a third of all rows takes one task's time (its digest is one sequence) but no memory beyond
its audit. Only ``messages=True`` holds the messages of one conversation.

Order is by turn (nulls first), role, text. Role and text that are null count as one space, a null ``conv_id`` is a
conversation of its own. A row whose role is empty has no initial: it is never kept, and it is illegal beside any other. A
row of blank text is blank however often it occurs; otherwise its second occurrence in the conversation is a duplicate, also
if a whole row is repeated. Texts may be of any length and are taken whole. Gaps beyond 64 bits are given as the largest
long. An empty table gives an empty result, and columns other than the four named ones are not read.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 64
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

_LETTERS = b"\0DIKR"
_D, _I, _K, _R = (_LETTERS.index(c) for c in b"DIKR")
_WIDTH = 3 * BLOCK + 2  # up to two turns are inserted before each row and after the last
_PLACES = [5**k for k in range(_WIDTH - 1, -1, -1)]
_RANK = 5**_WIDTH
_COST = 5 * _RANK

#: States: nothing yet, after s, after u, after a. Where each initial leads from each state.
_NEXT = {b"s": {0: 1}, b"u": {0: 2, 1: 2, 3: 2}, b"a": {2: 3}}
_MOVES = {c: [(q, to) for q, to in moves.items()] for c, moves in _NEXT.items()}
_ENDS = (0, 3)
_LEGAL = {b"su", b"ua", b"au"}
_NAMES = {b"u": b"user", b"a": b"assistant"}
_BLANK = b" \t\n\x0b\x0c\r"

SCHEMA = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


class Path:
    """The best way to one node: its weight, letters since the last block, and what it has made of the conversation."""

    __slots__ = ("weight", "used", "digest", "tail", "past", "made")

    def __init__(self, weight, used, digest, tail, past, made):
        self.weight, self.used, self.digest, self.tail, self.past, self.made = weight, used, digest, tail, past, made

    def then(self, cost: int, letter: int) -> int:
        """The weight after one more edit."""
        return self.weight + cost * _COST + letter * _PLACES[self.used]

    def letters(self) -> bytes:
        value, out = self.weight % _RANK, bytearray()
        for k in range(self.used):
            digit, value = divmod(value, _PLACES[k])
            out.append(_LETTERS[digit])
        return bytes(out)


class Conversation:
    """Takes the rows of one conversation in order; ``result`` gives its figures."""

    def __init__(self, keep_messages: bool = False):
        self.alive: list[Path | None] = [Path(0, 0, hashlib.sha256(), b"", None, None), None, None, None]
        self.keep_messages, self.rows = keep_messages, 0
        self.first = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial = None

    def add(self, turn: int | None, role: bytes, text: bytes, again: bool) -> None:
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in _LEGAL:
            self.illegal += 1
        self.initial = initial
        end = text.rstrip(_BLANK)[-1:]
        blank, duplicate = not end, bool(end) and again
        truncated = not blank and not duplicate and end not in b".!?"
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        self._step(initial, role, text, blank or duplicate, TRUNCATED if truncated else 0)
        self.rows += 1
        if self.rows % BLOCK == 0:
            self._settle()

    def _inserted(self) -> list[Path | None]:
        """The best way to each state after up to two inserted turns."""
        now = list(self.alive)
        layer = now
        for _ in range(2):
            fresh: list[Path | None] = [None] * 4
            for c in (b"u", b"a"):
                for q, to in _MOVES[c]:
                    p = layer[q]
                    if p is None:
                        continue
                    weight = p.then(INSERT, _I)
                    if fresh[to] is None or weight < fresh[to].weight:
                        tail = p.tail + (b"\n" if q else b"") + _NAMES[c] + b":"
                        made = (p.made, _NAMES[c], b"") if self.keep_messages else None
                        fresh[to] = Path(weight, p.used + 1, p.digest, tail, p.past, made)
            layer = fresh
            now = [y if x is None or (y is not None and y.weight < x.weight) else x for x, y in zip(now, fresh, strict=True)]
        return now

    def _step(self, initial: bytes, role: bytes, text: bytes, must_go: bool, extra: int) -> None:
        before = self._inserted()
        after: list[Path | None] = [None] * 4
        ways: list[tuple | None] = [None] * 4
        for q, p in enumerate(before):
            if p is not None:
                ways[q] = (p.then(DELETE, _D), p, None, q)
        if not must_go:
            choices = [(KEEP, _K, initial, role)] + [(REROLE, _R, c, name) for c, name in _NAMES.items()]
            for cost, letter, c, name in choices:
                for q, to in _MOVES.get(c, ()):
                    p = before[q]
                    if p is not None and (ways[to] is None or p.then(cost + extra, letter) < ways[to][0]):
                        ways[to] = (p.then(cost + extra, letter), p, name, q)
        for to, way in enumerate(ways):
            if way is None:
                continue
            weight, p, name, q = way
            if name is None:
                after[to] = Path(weight, p.used + 1, p.digest, p.tail, p.past, p.made)
                continue
            digest = p.digest.copy()
            digest.update(p.tail + (b"\n" if q else b"") + name + b":")
            digest.update(text)
            made = (p.made, name, text) if self.keep_messages else None
            after[to] = Path(weight, p.used + 1, digest, b"", p.past, made)
        self.alive = after

    def _settle(self) -> None:
        alive = sorted((p for p in self.alive if p is not None), key=lambda p: p.weight % _COST)
        for rank, p in enumerate(alive):
            p.past = (p.past, p.letters())
            p.weight, p.used = p.weight // _COST * _COST + rank * _RANK, 0

    def result(self) -> tuple:
        """Figures in the order of ``SCHEMA``, and the repaired messages (role, text) if they were to be kept."""
        ends = self._inserted()
        best = min((ends[q] for q in _ENDS if ends[q] is not None), key=lambda p: p.weight)
        parts, link = [best.letters()], best.past
        while link:
            parts.append(link[1])
            link = link[0]
        digest = best.digest.copy()
        digest.update(best.tail)
        gaps = 0 if self.first is None else min(self.last - self.first + 1 - self.turns, (1 << 63) - 1)
        messages, made = [], best.made
        while made:
            messages.append((made[1], made[2]))
            made = made[0]
        counts = (self.blank, self.duplicate, self.truncated, self.illegal, best.weight // _COST)
        return (gaps, *counts, b"".join(reversed(parts)).decode(), digest.hexdigest()), messages[::-1]


def ordered(rows: DataFrame, lost: Column | None = None) -> DataFrame:
    """conv_id, turn, role, text (bytes), lost, again (role and text seen earlier): each conversation in one partition, in
    order. One shuffle; the window and the last sort work on what it brought together."""
    flag = F.coalesce(lost, F.lit(False)) if lost is not None else F.lit(False)
    text = lambda c: F.when(~flag, F.coalesce(F.col(c).cast("string"), F.lit(" "))).cast("binary")
    found = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), text("role").alias("role"), text("text").alias("text"), flag.alias("lost"))
    found = found.repartition("conv_id")
    same = W.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    found = found.withColumn("place", F.row_number().over(same))
    found = found.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "place")
    return found.select("conv_id", "turn", "role", "text", "lost", (F.col("place") > 1).alias("again"))


def repair(rows: DataFrame, lost: Column | None = None, messages: bool = False) -> DataFrame:
    """One row for each ``conv_id``: gaps, the counts of faults, cost, audit and the digest of the repaired conversation
    (``role:text`` joined by line feeds). Rows for which ``lost`` holds only name their conversation. With ``messages`` the
    repaired rows too, as an array of (role, text)."""
    id_type = dict(rows.dtypes)["conv_id"]
    schema = f"conv_id {id_type}, {SCHEMA}" + ", messages array<struct<role: string, text: string>>" * messages

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = None
        ids, out = [], []
        now, open_id, begun = None, None, False

        def flush() -> pa.RecordBatch:
            columns = [pa.concat_arrays(ids).cast(arrow)] if ids else [pa.array([], arrow)]
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            columns += [pa.array([r[0][k] for r in out], kind) for k, kind in enumerate(kinds)]
            names = ["conv_id", *(c.split()[0] for c in SCHEMA.split(", "))]
            if messages:
                kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
                said = lambda m: {"role": m[0].decode("utf-8", "replace"), "text": m[1].decode("utf-8", "replace")}
                columns.append(pa.array([[said(m) for m in r[1]] for r in out], kind))
                names.append("messages")
            ids.clear()
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            column = batch.column("conv_id")
            arrow = column.type
            turns, lost_rows, again = (batch.column(c).to_pylist() for c in ("turn", "lost", "again"))
            roles, texts = batch.column("role"), batch.column("text")
            for k, conv in enumerate(column.to_pylist()):
                if not begun or conv != open_id:
                    if begun:
                        out.append(now.result())
                    now, open_id, begun = Conversation(messages), conv, True
                    ids.append(column.slice(k, 1))
                    if len(out) >= 1000:
                        held = ids.pop()
                        yield flush()
                        ids.append(held)
                if not lost_rows[k]:
                    now.add(turns[k], roles[k].as_py(), texts[k].as_py(), again[k])
        if begun:
            out.append(now.result())
            yield flush()

    return ordered(rows, lost).mapInArrow(walk, schema)


def damaged(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """Conversations with the faults of the query's rule, and the condition for lost rows: by the check sum of
    ``conv_id:turn`` (null: a space) a twentieth each is lost, emptied, stripped of ``. ! ?``, repeated and said by user."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), "kind", F.explode(copies).alias("copy"))
    return rows.drop("copy"), F.col("kind") == 0
