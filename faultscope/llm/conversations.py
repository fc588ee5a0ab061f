"""Repair of the structure of conversations by a cheapest sequence of edits.

The role initials of a repaired conversation read ``(s?(ua)+)?``. Rows are
kept, given another role or deleted, and empty rows inserted; the audit is the
least string, in ASCII order, of those that cost least.

The costs still to come from each of the four states of that pattern, less the
least of them, form a vector; only a few vectors occur. For every vector and
every block of ``BLOCK`` row symbols a table, made once, holds the vector before
the block and what the block adds (Four Russians). A conversation is processed
from its end by one lookup per block. Then each block is expanded: the vectors
between its rows say which edits lie on a cheapest way, and going forward from
the known state the least letter of these is always right, since a letter and
a state determine the next state.

Rows are sorted by conversation over all tasks, so a conversation may lie in
several of them. Those inside one task are finished there. Of the others, the
first and last of each task and long ones, each piece sends its effect on all
vectors and states; these are chained per conversation, and the pieces are
traced with the vector and state they then start from. The text of such a
conversation passes through one task only to be hashed, as a stream.

Defined cases: nulls of role and text are one space, those of conv_id and turn
too where they are hashed; a null conv_id is a conversation of its own; null
turns come first; rows of one turn are ordered by role and the SHA-256 of their
text; an empty role has no initial and fits nowhere; no rows, no result.
"""

from __future__ import annotations

import hashlib
from functools import cache
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultscope.llm.common import land

KEEP, RETRUNCATED, REROLE, DELETE, INSERT = 0, 3, 3, 4, 3
#: Rows of a block, and rows and characters of a piece of a conversation that several tasks hold.
BLOCK, PIECE_ROWS, PIECE_CHARS = 4, 4096, 1 << 20
BLANKS = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}
ROLES = {2: "user", 3: "assistant"}
#: States: nothing yet, after s, after u, after a; where an inserted or rerole row leads; which initials are kept where.
START, NEXT = 0, (2, 2, 3, 2)
KEPT = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})
#: Symbols: 0 must be deleted, 1 + 2 * initial (s, u, a, other) + truncated, 9 no row.
NO_ROW, SYMBOLS = 9, 10


def _closed(costs: list[int]) -> tuple[int, ...]:
    """Costs to come once rows may be inserted first."""
    start, s, u, a = costs
    u, a = min(u, INSERT + a), min(a, INSERT + u)
    return min(start, INSERT + u), min(s, INSERT + u), u, a


def _before(after: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Costs to come before a row, from those after it."""
    if symbol == NO_ROW:
        return after
    costs = [DELETE + c for c in after]
    if symbol:
        kind, truncated = divmod(symbol - 1, 2)
        more = RETRUNCATED * truncated
        costs = [min(c, REROLE + more + after[NEXT[s]], *([KEEP + more + after[KEPT[kind][s]]] if s in KEPT[kind] else [])) for s, c in enumerate(costs)]
    return _closed(costs)


class Automaton:
    """All vectors that occur, and the tables of single rows and of blocks."""

    def __init__(self, block: int = BLOCK):
        end = _closed([0, 1 << 20, 1 << 20, 0])
        self.vectors, index, steps = [end], {end: 0}, []
        for v in self.vectors:
            row = []
            for symbol in range(SYMBOLS):
                costs = _before(v, symbol)
                least = min(costs)
                costs = tuple(c - least for c in costs)
                if costs not in index:
                    index[costs] = len(self.vectors)
                    self.vectors.append(costs)
                row.append((index[costs], least))
            steps.append(row)
        self.block = block
        self.step, self.step_adds = np.array(steps).transpose(2, 0, 1)
        to = np.repeat(np.arange(len(self.vectors))[:, None], SYMBOLS**block, 1)
        add = np.zeros_like(to)
        digits = np.array(list(product(range(SYMBOLS), repeat=block)))
        for k in reversed(range(block)):
            add += self.step_adds[to, digits[:, k]]
            to = self.step[to, digits[:, k]]
        self.to, self.add = to, add
        self.to_rows, self.add_rows = to.tolist(), add.tolist()
        self.expanded: dict[tuple[int, int, int], tuple[str, int]] = {}

    def codes(self, symbols) -> list[int]:
        """Block numbers of a row of symbols."""
        s = np.full(-(-len(symbols) // self.block) * self.block, NO_ROW)
        s[: len(symbols)] = list(symbols)
        return (s.reshape(-1, self.block) @ SYMBOLS ** np.arange(self.block)[::-1]).tolist()

    def backward(self, codes: list[int], vector: int) -> tuple[list[int], int, int]:
        """The vector behind each block, the one before all of them, and the sum of what was taken off."""
        behind, total = [0] * len(codes), 0
        for k in range(len(codes) - 1, -1, -1):
            behind[k] = vector
            total += self.add_rows[vector][codes[k]]
            vector = self.to_rows[vector][codes[k]]
        return behind, vector, total

    def trace(self, vector: int, state: int, code: int) -> tuple[str, int]:
        """The edits of one block, and the state behind it; ``vector`` is the one behind the block."""
        key = vector, state, code
        if key not in self.expanded:
            symbols = [code // SYMBOLS**k % SYMBOLS for k in reversed(range(self.block))]
            after = [vector]
            for symbol in reversed(symbols[1:]):
                after.append(int(self.step[after[-1], symbol]))
            letters = ""
            for symbol, v in zip(symbols, reversed(after), strict=True):
                some, state = self._row(self.vectors[v], symbol, state)
                letters += some
            self.expanded[key] = letters, state
        return self.expanded[key]

    def _row(self, after: tuple[int, ...], symbol: int, state: int) -> tuple[str, int]:
        if symbol == NO_ROW:
            return "", state
        before, letters = _before(after, symbol), ""
        kind, truncated = divmod(symbol - 1, 2)
        more = RETRUNCATED * truncated
        while True:
            if before[state] == DELETE + after[state]:
                return letters + "D", state
            if before[state] == INSERT + before[NEXT[state]]:
                letters, state = letters + "I", NEXT[state]
            elif state in KEPT[kind] and before[state] == KEEP + more + after[KEPT[kind][state]]:
                return letters + "K", KEPT[kind][state]
            else:
                return letters + "R", NEXT[state]

    @staticmethod
    def ending(state: int) -> str:
        """What is inserted after the last row."""
        return ("", "II", "I", "")[state]

    def edits(self, codes: list[int], vector: int, state: int) -> tuple[str, int]:
        """All edits of a piece, and the state behind it."""
        behind, out = self.backward(codes, vector)[0], []
        for v, code in zip(behind, codes, strict=True):
            letters, state = self.trace(v, state, code)
            out.append(letters)
        return "".join(out), state

    def effect(self, codes: list[int]) -> tuple[list[int], list[int], list[int]]:
        """For every vector behind a piece the one before it and the sum taken off, and for every state the one behind."""
        to, adds, states = [], [], []
        for v in range(len(self.vectors)):
            behind, first, total = self.backward(codes, v)
            to.append(first)
            adds.append(total)
            for s in range(4):
                for b, code in zip(behind, codes, strict=True):
                    s = self.trace(b, s, code)[1]
                states.append(s)
        return to, adds, states


@cache
def automaton(block: int = BLOCK) -> Automaton:
    return Automaton(block)


def repaired_lines(letters: str, state: int, roles: list[str], texts: list[str]) -> list[str]:
    """``role:text`` of the rows that edits leave."""
    out, i = [], 0
    for letter in letters:
        if letter == "D":
            i += 1
        elif letter == "I":
            state = NEXT[state]
            out.append(ROLES[state] + ":")
        elif letter == "R":
            state = NEXT[state]
            out.append(f"{ROLES[state]}:{texts[i]}")
            i += 1
        else:
            state = KEPT["sua".index(roles[i][0])][state]
            out.append(f"{roles[i]}:{texts[i]}")
            i += 1
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """``k_conv, turn, role, text, copies``: the rows after damage; dropped ones stay with 0 copies and no text."""
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("long")
    spaced = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    key = F.when(conv.isNull(), "").otherwise(F.concat(F.lit("="), conv))
    kind = (F.crc32(F.concat(spaced(conv), F.lit(":"), spaced(turn)).cast("binary")) % 20).alias("kind")
    base = rows.select(key.alias("k_conv"), turn.alias("turn"), spaced(F.col("role")).alias("role"), spaced(F.col("text")).alias("text"), kind)
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return base.select("k_conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def _symbol(role: Column, text: Column) -> Column:
    """0 for a blank text, else 1 + 2 * initial + truncated."""
    kept = F.rtrim(text, F.lit(BLANKS))
    initial = F.substring(role, 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    whole = F.substring(kept, -1, 1).isin(".", "!", "?")
    return F.when(kept == "", 0).otherwise(1 + 2 * kind + F.when(whole, 0).otherwise(1))


STATS = ["blank", "duplicate", "truncated", "illegal", "turns"]
PIECE = (
    "k_conv string, part long, no long, open boolean, n_rows long, blank long, duplicate long, truncated long, illegal long, turns long, "
    "first_turn long, last_turn long, first_role string, last_role string, cost long, audit string, repaired_sha256 string, "
    "symbols binary, roles array<string>, texts array<string>, back array<int>, adds array<long>, states array<int>"
)


class _Piece:
    """Rows of one conversation as they come, in order."""

    def __init__(self, key: str, no: int, last_role: str = "", first: bool = True):
        self.key, self.no, self.first = key, no, first
        self.symbols, self.roles, self.texts, self.chars = bytearray(), [], [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = None
        self.seen = None
        self.mark = None

    def add(self, turn, role: str, text: str, digest: bytes, symbol: int, copies: int) -> None:
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        here = turn, role, digest
        for _ in range(copies):
            repeated = self.seen == here or self.mark == here
            self.seen = here
            if not symbol:
                self.blank += 1
            elif repeated:
                self.duplicate += 1
            elif symbol % 2 == 0:
                self.truncated += 1
            if self.roles and self.roles[-1][:1] + role[:1] not in LEGAL:
                self.illegal += 1
            self.symbols.append(0 if repeated else symbol)
            self.roles.append(role)
            self.texts.append(text)
            self.chars += len(text)

    def closed(self) -> dict:
        machine = automaton()
        codes = machine.codes(self.symbols)
        _, vector, total = machine.backward(codes, 0)
        letters, state = machine.edits(codes, 0, START)
        letters += machine.ending(state)
        lines = repaired_lines(letters, START, self.roles, self.texts)
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        return self.row(open=False, cost=total + machine.vectors[vector][START], audit=letters, repaired_sha256=sha)

    def opened(self) -> dict:
        machine = automaton()
        back, adds, states = machine.effect(machine.codes(self.symbols))
        return self.row(open=True, symbols=bytes(self.symbols), roles=self.roles, texts=self.texts, back=back, adds=adds, states=states)

    def row(self, **more) -> dict:
        return {
            "k_conv": self.key, "no": self.no, "n_rows": len(self.symbols), **{k: getattr(self, k) for k in STATS},
            "first_turn": self.first_turn, "last_turn": self.last_turn, "first_role": self.roles[0][:1] if self.roles else None,
            "last_role": self.roles[-1][:1] if self.roles else None, **more,
        }


def _arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(),
             "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in PIECE.split(", ") if not c.startswith("part ")])


def pieces(rows: DataFrame, piece_rows: int = PIECE_ROWS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """One row per conversation that lies inside one task, finished, and one per piece of the others (``PIECE``); landed."""
    base = damaged(rows).withColumn("digest", F.unhex(F.sha2("text", 256)))
    # Rows of a role and text that came in an earlier turn are marked: the mark sorts just before them.
    spoken = base.where("copies > 0").groupBy("k_conv", "role", "digest", "turn").count()
    # Turns as sortable values, null lowest.
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    repeated = spoken.groupBy("k_conv", "role", "digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    keys = ["k_conv", "role", "digest"]
    marks = spoken.join(repeated, keys).where(~order.eqNullSafe(F.col("first")))
    marks = marks.select("k_conv", "turn", "role", F.lit(None).cast("string").alias("text"), F.lit(-1).alias("copies"), "digest")
    every = base.unionByName(marks).withColumn("symbol", F.when(F.col("copies") > 0, _symbol(F.col("role"), F.col("text"))).otherwise(0))
    order_by = ["k_conv", "turn", "role", "digest"]
    dealt = every.repartitionByRange(*order_by).sortWithinPartitions(*order_by, "copies")
    schema = _arrow_schema()

    def scan(batches):
        out, held = [], 0
        piece, first, last_role = None, True, ""

        def batch():
            return pa.RecordBatch.from_pylist(out, schema)

        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("k_conv", "turn", "role", "text", "digest", "symbol", "copies")]
            for key, turn, role, text, digest, symbol, copies in zip(*columns, strict=True):
                if piece is None or key != piece.key:
                    if piece is not None:
                        # Complete: it neither began in an earlier task nor goes on in a later one.
                        out.append(piece.opened() if first or piece.no else piece.closed())
                        held += piece.chars if first or piece.no else 200
                        first = False
                    piece = _Piece(key, 0)
                elif len(piece.symbols) >= piece_rows or piece.chars >= piece_chars:
                    out.append(piece.opened())
                    held += piece.chars
                    following = _Piece(key, piece.no + 1)
                    following.seen, following.mark = piece.seen, piece.mark
                    piece = following
                if copies < 0:
                    piece.mark = turn, role, digest
                elif copies:
                    piece.add(turn, role, text, digest, symbol, copies)
                if held > 4 << 20 or len(out) >= 5000:
                    yield batch()
                    out, held = [], 0
        if piece is not None:
            out.append(piece.opened())
            yield batch()

    plain = PIECE.replace("part long, ", "")
    return land(dealt.mapInArrow(scan, plain).withColumn("part", F.spark_partition_id().cast("long")), "conversation-pieces")


CHAIN = "k_conv string, part long, no long, vector int, state int, ending string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def chained(open_pieces: DataFrame) -> DataFrame:
    """For every piece the vector behind it and the state it starts from, and the figures of its conversation (``CHAIN``).

    A task sees one row of some hundred bytes per piece of a conversation.
    """

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        machine = automaton()
        pdf = pdf.sort_values(["part", "no"], ignore_index=True)
        vector, total, vectors = 0, 0, []
        for back, adds in zip(pdf["back"][::-1], pdf["adds"][::-1], strict=True):
            vectors.append(vector)
            total += int(adds[vector])
            vector = int(back[vector])
        vectors.reverse()
        state, states = START, []
        for v, known in zip(vectors, pdf["states"], strict=True):
            states.append(state)
            state = int(known[4 * v + state])
        told = pdf[pdf["n_rows"] > 0]
        illegal = int(pdf["illegal"].sum()) + sum(a + b not in LEGAL for a, b in zip(told["last_role"][:-1], told["first_role"][1:], strict=True))
        timed = pdf[pdf["turns"] > 0]
        turns = int(timed["turns"].sum()) - sum(a == b for a, b in zip(timed["last_turn"][:-1], timed["first_turn"][1:], strict=True))
        gaps = int(timed["last_turn"].iloc[-1]) - int(timed["first_turn"].iloc[0]) + 1 - turns if len(timed) else 0
        ending = [""] * len(pdf)
        ending[-1] = machine.ending(state)
        return pd.DataFrame({
            "k_conv": pdf["k_conv"], "part": pdf["part"], "no": pdf["no"], "vector": vectors, "state": states, "ending": ending, "gaps": gaps,
            **{c: int(pdf[c].sum()) for c in ("blank", "duplicate", "truncated")}, "illegal": illegal, "cost": total + machine.vectors[vector][START],
        })

    columns = [c.split()[0] for c in PIECE.split(", ")]
    small = [c for c in columns if c not in ("open", "cost", "audit", "repaired_sha256", "symbols", "roles", "texts")]
    # Turns travel as strings: a missing long would become a float in pandas.
    texts = [F.col(c).cast("string").alias(c) if c in ("first_turn", "last_turn") else F.col(c) for c in small]
    return land(open_pieces.select(*texts).groupBy("k_conv").applyInPandas(chain, CHAIN), "conversation-chain")


REPAIRED = "k_conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repaired_open(open_pieces: DataFrame) -> DataFrame:
    """Rows (``REPAIRED``) of the conversations that come in pieces."""
    known = chained(open_pieces)
    joined = open_pieces.select("k_conv", "part", "no", "symbols", "roles", "texts").join(known, ["k_conv", "part", "no"])
    figures = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    segment = "k_conv string, part long, no long, " + ", ".join(f"{c} long" for c in figures) + ", audit string, lines long, body string"

    def trace(batches):
        machine = automaton()
        for b in batches:
            for k in range(b.num_rows):
                r = {c: b.column(c)[k].as_py() for c in b.schema.names}
                letters, _ = machine.edits(machine.codes(r["symbols"]), r["vector"], r["state"])
                letters += r["ending"]
                lines = repaired_lines(letters, r["state"], r["roles"], r["texts"])
                row = {c: r[c] for c in ("k_conv", "part", "no", *figures)}
                yield pa.RecordBatch.from_pylist([{**row, "audit": letters, "lines": len(lines), "body": "\n".join(lines)}], schema=wanted)

    wanted = pa.schema([(c.split()[0], pa.string() if c.split()[1] == "string" else pa.int64()) for c in segment.split(", ")])
    segments = joined.mapInArrow(trace, segment)
    segments = segments.repartition("k_conv").sortWithinPartitions("k_conv", "part", "no")

    def join(batches):
        key, row, audit, sha, begun = None, None, [], None, False

        def done():
            return pa.RecordBatch.from_pylist([{**row, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}], schema=final)

        for b in batches:
            for k in range(b.num_rows):
                this = b.column("k_conv")[k].as_py()
                if this != key:
                    if key is not None:
                        yield done()
                    key, audit, sha, begun = this, [], hashlib.sha256(), False
                    row = {c: b.column(c)[k].as_py() for c in ("k_conv", *figures)}
                audit.append(b.column("audit")[k].as_py())
                if b.column("lines")[k].as_py():
                    sha.update((b"\n" if begun else b"") + b.column("body")[k].as_py().encode())
                    begun = True
        if key is not None:
            yield done()

    final = pa.schema([(c.split()[0], pa.string() if c.split()[1] == "string" else pa.int64()) for c in REPAIRED.split(", ")])
    return segments.mapInArrow(join, REPAIRED)


def repair(rows: DataFrame, piece_rows: int = PIECE_ROWS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``."""
    landed = pieces(rows, piece_rows, piece_chars)
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    whole = landed.where("not open").select("k_conv", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    every = whole.unionByName(repaired_open(landed.where("open")))
    kind = rows.schema["conv_id"].dataType
    conv = F.when(F.col("k_conv") != "", F.substring("k_conv", 2, 2**31 - 1)).cast(kind).alias("conv_id")
    return every.select(conv, *[c.split()[0] for c in REPAIRED.split(", ")[1:]])
