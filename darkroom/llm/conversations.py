"""Conversation structure repair by lazy weighted determinisation.

A weighted automaton reads the rows of a conversation and writes role initials of the form ``(s?(ua)+)?``: a row is kept, gets the other role, or is deleted,
and empty rows may be inserted. Its four places are the start, after ``s``, after ``u`` and after ``a``.

* The costs of all places after a row, less their minimum, are one state of a deterministic automaton. States come into being when they are first met and
  their transitions are kept in a table, so a scan of the rows is one table look-up each. Places that can't be on a cheapest path (see ``_settled``) count as
  out of reach, which leaves a few dozen states.
* A trace from the last row to the first follows the tight arcs (those on cheapest paths), also by a table. The ASCII-least audit is then read off
  going forward along traced arcs.

Rows are range-partitioned by conversation and turn, equal rows counted before; each range gives pieces of one byte a row. Only these bytes meet in one task
for one conversation, as its audit, a value with a letter a row, must. Texts don't, but for the repaired rows of a conversation, which are written in their order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.operators.skew import join_counted
from darkroom.runtime import discard, materialise, ship, shuffle_partitions

START, S, U, A = range(4)
OUT = 1 << 20
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: The place that an inserted row, or a row with a changed role, leads to.
NEXT = (U, U, A, U)
#: A code is the role's initial (s, u, a, other), 4 if truncated, 8 if the row must go.
GONE = 8
LEGAL = {(0, 1), (1, 2), (2, 1)}
PIECE = 1 << 20


def _row_arcs(code: int) -> list[tuple[str, int, int, int]]:
    """(letter, from, to, cost) of a row."""
    arcs = [("D", q, q, DELETE) for q in range(4)]
    if code & GONE:
        return arcs
    late = TRUNCATED if code & 4 else 0
    role = code & 3
    for q in range(4):
        if (role == 0 and q == START) or (role == 1 and NEXT[q] == U) or (role == 2 and NEXT[q] == A):
            arcs.append(("K", q, S if role == 0 else NEXT[q], late))
        arcs.append(("R", q, NEXT[q], REROLE + late))
    return arcs


class Automaton:
    """The deterministic automaton, built as far as it has been used."""

    def __init__(self):
        self.arcs = [_row_arcs(c) for c in range(16)]
        self.states: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.table: list[list[tuple[int, int] | None]] = []
        self.marks: dict[tuple[int, int, int], int] = {}
        self.letters: dict[tuple[int, int, int, int, int], tuple[str, int]] = {}
        self.first, _ = self._settled([0, OUT, OUT, OUT])

    def _settled(self, costs: list[int]) -> tuple[int, int]:
        """Number of the state with these costs, inserts added, and what was taken off.

        From after ``a`` all can be done that the start can do, at 2 more at most (an ``s`` row is deleted, not kept), and all that can be done after ``s``; places
        that cost more than that are never on a cheapest path.
        """
        for _ in range(3):
            for q in range(4):
                costs[NEXT[q]] = min(costs[NEXT[q]], costs[q] + INSERT)
        if costs[START] > costs[A] + DELETE:
            costs[START] = OUT
        if costs[S] > costs[A]:
            costs[S] = OUT
        low = min(costs)
        vector = tuple(OUT if c >= OUT else c - low for c in costs)
        if vector not in self.numbers:
            self.numbers[vector] = len(self.states)
            self.states.append(vector)
            self.table.append([None] * 16)
        return self.numbers[vector], low

    def step(self, state: int, code: int) -> tuple[int, int]:
        """State after a row, and what it adds to all costs."""
        found = self.table[state][code]
        if found is None:
            costs = [OUT] * 4
            for _, a, b, c in self.arcs[code]:
                if self.states[state][a] < OUT:
                    costs[b] = min(costs[b], self.states[state][a] + c)
            found = self.table[state][code] = self._settled(costs)
        return found

    def _inserts(self, state: int, marked: int) -> int:
        """Places from which tight inserts lead to marked ones, these included."""
        v = self.states[state]
        for _ in range(3):
            for q in range(4):
                if marked >> NEXT[q] & 1 and v[q] + INSERT == v[NEXT[q]] < OUT:
                    marked |= 1 << q
        return marked

    def last_marks(self, state: int) -> int:
        """Places on cheapest paths after the last row."""
        v = self.states[state]
        best = min(v[START], v[A])
        return self._inserts(state, sum(1 << q for q in (START, A) if v[q] == best))

    def back(self, state: int, code: int, marked: int) -> int:
        """Places on cheapest paths before a row, from those after it."""
        key = state, code, marked
        if key not in self.marks:
            after, added = self.step(state, code)
            v, w, here = self.states[state], self.states[after], 0
            for _, a, b, c in self.arcs[code]:
                if marked >> b & 1 and v[a] < OUT and v[a] + c == w[b] + added:
                    here |= 1 << a
            self.marks[key] = self._inserts(state, here)
        return self.marks[key]

    def ahead(self, state: int, code: int, before: int, after: int, place: int) -> tuple[str, int]:
        """Least letters from a place through a row along marked tight arcs, and the place after it."""
        key = state, code, before, after, place
        if key not in self.letters:
            following, added = self.step(state, code)
            v, w, said = self.states[state], self.states[following], ""
            while True:
                ways = [(letter, b) for letter, a, b, c in self.arcs[code] if a == place and after >> b & 1 and v[a] + c == w[b] + added]
                if before >> NEXT[place] & 1 and v[place] + INSERT == v[NEXT[place]]:
                    ways.append(("I", NEXT[place]))
                letter, place = min(ways)
                said += letter
                if letter != "I":
                    break
            self.letters[key] = said, place
        return self.letters[key]

    def ending(self, state: int, place: int) -> str:
        """Inserts after the last row."""
        v, said = self.states[state], ""
        while place not in (START, A) or v[place] != min(v[START], v[A]):
            said, place = said + "I", NEXT[place]
        return said

    def repair(self, codes: bytes, more: dict[int, int]) -> tuple[int, str]:
        """Cost and audit of a conversation. ``more`` has further equal rows by the number of their first one; these can only be deleted."""
        state, cost, states = self.first, 0, []
        for code in codes:
            states.append(state)
            state, added = self.table[state][code] or self.step(state, code)
            cost += added
        cost += min(self.states[state][START], self.states[state][A]) + DELETE * sum(more.values())
        marked = [self.last_marks(state)]
        for s, code in zip(reversed(states), reversed(codes)):
            marked.append(self.back(s, code, marked[-1]))
        marked.reverse()
        place, said = START, []
        for t, code in enumerate(codes):
            letters, place = self.ahead(states[t], code, marked[t], marked[t + 1], place)
            said.append(letters + "D" * more[t] if t in more else letters)
        return cost, "".join(said) + self.ending(state, place)


def _illegal(codes: bytes) -> int:
    return sum((a & 3, b & 3) not in LEGAL for a, b in zip(codes, codes[1:]))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ck, part, no, codes, at, more) of runs of rows of one conversation, in order."""
    names, kinds = ["ck", "part", "no", "codes", "at", "more"], [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
    held: list = []
    no = 0

    def flushed(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)

    for batch in batches:
        n, done = batch.num_rows, []
        if not n:
            continue
        ck, part = batch.column("ck"), batch.column("part")[0].as_py()
        codes, copies = batch.column("code").to_numpy().astype("u1"), batch.column("copies").to_numpy()
        cuts = [0] + (pc.indices_nonzero(pc.not_equal(ck.slice(1), ck.slice(0, n - 1))).to_numpy() + 1).tolist() + [n]
        for a, b in zip(cuts, cuts[1:]):
            key = ck[a].as_py()
            if held and (held[0] != key or len(held[1]) >= PIECE):
                done.append((held[0], part, no, bytes(held[1]), held[2], held[3]))
                held, no = [], no + 1
            if not held:
                held = [key, bytearray(), [], []]
            for i in (copies[a:b] > 1).nonzero()[0].tolist():
                held[2].append(len(held[1]) + i)
                held[3].append(int(copies[a + i]) - 1)
            held[1] += codes[a:b].tobytes()
        if done:
            yield flushed(done)
    if held:
        yield flushed([(held[0], part, no, bytes(held[1]), held[2], held[3])])


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = Automaton()
    for batch in batches:
        out = []
        for ck, pieces in zip(batch.column("ck").to_pylist(), batch.column("pieces")):
            codes, more = bytearray(), {}
            for p in pieces.as_py():
                more.update((len(codes) + i, n) for i, n in zip(p["at"], p["more"]))
                codes += p["codes"]
            cost, audit = automaton.repair(bytes(codes), more)
            out.append((ck, _illegal(codes) + sum(more.values()), cost, audit))
        kinds = pa.string(), pa.int64(), pa.int64(), pa.string()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["ck", "illegal", "cost", "audit"])


class _Writer:
    """Rows of a repaired conversation from its audit and its rows in order."""

    def __init__(self, ck: str, audit: str):
        self.ck, self.audit, self.at, self.n = ck, audit, 0, 0
        self.shift = (len(audit) - audit.count("D")) % 2

    def _role(self) -> str:
        return "user" if (self.n - self.shift) % 2 == 0 else "assistant"

    def inserted(self) -> Iterator[tuple]:
        """Inserted rows that come next."""
        while self.audit[self.at : self.at + 1] == "I":
            yield self.ck, self.n, self._role(), ""
            self.at, self.n = self.at + 1, self.n + 1

    def row(self, role: str, text: str, copies: int) -> Iterator[tuple]:
        """What becomes of a row and its copies."""
        yield from self.inserted()
        letter = self.audit[self.at]
        if letter != "D":
            yield self.ck, self.n, role if letter == "K" else self._role(), text
            self.n += 1
        self.at += copies


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ck, n, role, text) of repaired conversations; each conversation's audit comes before its rows."""
    writer = None
    kinds = pa.string(), pa.int64(), pa.string(), pa.string()

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["ck", "n", "role", "text"])

    for batch in batches:
        rows = []
        for ck, audit, role, text, copies in zip(*(batch.column(c).to_pylist() for c in ("ck", "audit", "role", "text", "copies"))):
            if audit is not None:
                rows.extend(writer.inserted() if writer else ())
                writer = _Writer(ck, audit)
            else:
                rows.extend(writer.row(role, text, copies))
        if rows:
            yield made(rows)
    if writer:
        yield made(list(writer.inserted()))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ck, repaired_sha256) of conversations whose rows come one after another."""
    now, digest, done = None, None, []
    for batch in batches:
        for ck, role, text in zip(*(batch.column(c).to_pylist() for c in ("ck", "role", "text"))):
            if ck != now:
                if digest:
                    done.append((now, digest.hexdigest()))
                now, digest = ck, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        if len(done) > 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], ["ck", "repaired_sha256"])
            done = []
    if digest:
        done.append((now, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], ["ck", "repaired_sha256"])


SPACE = r"\x20\x09-\x0D"


def _shown(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(" "))


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows as a faulty export would leave them: conv_id, turn, role, text, copies.

    By crc32 of ``conv_id:turn`` modulo 20 a row is dropped (0), loses its text (1), loses its ``.!?`` (2), comes twice (3) or becomes a user's (4).
    Nulls count as one space, but for the order and gaps of turns.
    """
    c, t = F.col(f"`{conv_id}`"), F.col(f"`{turn}`")
    kind = F.crc32(F.concat(_shown(c), F.lit(":"), _shown(t))) % 20
    said = _shown(F.col(f"`{text}`"))
    return rows.select(
        c.alias("conv_id"), t.alias("turn"), F.when(kind == 4, "user").otherwise(_shown(F.col(f"`{role}`"))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(said, ".!?", "")).otherwise(said).alias("text"), F.when(kind == 3, 2).otherwise(1).cast("bigint").alias("copies"), kind.alias("kind"),
    ).where("kind <> 0").drop("kind")


def _key(conv_id: Column) -> Column:
    """A conversation's key: text that is never null."""
    return F.when(conv_id.isNull(), "n").otherwise(F.concat(F.lit("v"), conv_id.cast("string")))


def _unkeyed(ck: Column, kind) -> Column:
    return F.when(ck != "n", F.substring(ck, 2, 2**31 - 1)).cast(kind)


class Repair:
    """Repaired conversations of rows (conv_id, turn, role, text and, if given, copies).

    A conversation's rows are taken by turn, nulls first; rows of one turn in the order of their SHA-256 (of role and text). A row's first fault counts: blank (nothing but white
    space), duplicate (role and text seen earlier), truncated (doesn't end in ``.!?``). Keeping a row costs 0, another role 1, deleting 2 (blank rows and duplicates must go), inserting
    an empty row 5, leaving a truncated row 5. A role is known by its initial; an empty role has none, so its row can't be kept as it is. Null conv_id is
    a conversation of its own; null roles and texts count as one space. Any number of equal rows is one row with a count. Empty tables give empty results; other columns are ignored.
    """

    def __init__(self, rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None):
        spark = rows.sparkSession
        ship(spark)
        self.kind = rows.select(F.col(f"`{conv_id}`")).schema[0].dataType
        one = rows.select(
            _key(F.col(f"`{conv_id}`")).alias("ck"), F.col(f"`{turn}`").cast("bigint").alias("turn"), _shown(F.col(f"`{role}`")).alias("role"), _shown(F.col(f"`{text}`")).alias("text"),
            (F.col(f"`{copies}`") if copies else F.lit(1)).cast("bigint").alias("copies"),
        )
        one = one.withColumn("key", F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
        # equal rows of a turn are counted before they are moved
        cells = one.groupBy("ck", "turn", "key").agg(F.first("role").alias("role"), F.first("text").alias("text"), F.sum("copies").alias("copies"))
        initial = F.array_position(F.array(*map(F.lit, "sua")), F.substring("role", 1, 1)).cast("int")
        self.cells = materialise(
            cells.withColumns({
                "initial": F.when(initial == 0, 3).otherwise(initial - 1), "blank": ~F.col("text").rlike(f"[^{SPACE}]"),
                "truncated": F.col("text").rlike(rf"[^{SPACE}.!?][{SPACE}]*\z"),
            }),
            "conv-cells",
        )
        first = self.cells.groupBy("ck", "key").agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        flagged = join_counted(self.cells.select("ck", "turn", "key", "copies", "initial", "blank", "truncated"), first, ["ck", "key"], how="left")
        flagged = flagged.withColumn("again", F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn")))
        code = F.col("initial") + F.when(F.col("truncated"), 4).otherwise(0) + F.when(F.col("blank") | F.col("again"), GONE).otherwise(0)
        flagged = materialise(flagged.select("ck", "turn", "key", "copies", "blank", "again", "truncated", code.alias("code")), "conv-codes")
        good = ~F.col("blank")
        self.counts = flagged.groupBy("ck").agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"), F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
            F.sum(F.when(good & F.col("again"), F.col("copies")).when(good, F.col("copies") - 1).otherwise(0)).alias("duplicate"),
            F.count_if(good & ~F.col("again") & F.col("truncated")).alias("truncated"),
        )
        order = ["ck", "turn", "key"]
        ranged = flagged.select(*order, "copies", "code").repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
        pieces = ranged.select("ck", "copies", "code", F.spark_partition_id().alias("part")).mapInArrow(_pieces, "ck string, part int, no int, codes binary, at array<int>, more array<bigint>")
        pieces = materialise(pieces, "conv-pieces")
        joined = pieces.groupBy("ck").agg(F.array_sort(F.collect_list(F.struct("part", "no", "codes", "at", "more"))).alias("pieces"))  # a byte a row, as the audit has a letter a row
        self.repairs = materialise(joined.mapInArrow(_repairs, "ck string, illegal bigint, cost bigint, audit string"), "conv-repairs")
        discard(pieces)

    def audits(self) -> DataFrame:
        """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
        return self._audits().withColumn("conv_id", _unkeyed(F.col("ck"), self.kind)).drop("ck")

    def _audits(self) -> DataFrame:
        return self.counts.join(self.repairs, "ck")

    def _rows(self) -> DataFrame:
        nothing = F.lit(None).cast("string")
        said = self.repairs.select("ck", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("binary").alias("key"), "audit", nothing.alias("role"), nothing.alias("text"), F.lit(0).cast("bigint").alias("copies"))
        rows = self.cells.select("ck", F.lit(1).alias("kind"), "turn", "key", nothing.alias("audit"), "role", "text", "copies")
        # rows of one conversation are written, and hashed, one after another
        ordered = said.unionAll(rows).repartition(shuffle_partitions(self.cells.sparkSession), "ck").sortWithinPartitions("ck", "kind", "turn", "key")
        return ordered.select("ck", "audit", "role", "text", "copies").mapInArrow(_written, "ck string, n bigint, role string, text string")

    def rows(self) -> DataFrame:
        """The repaired conversations: conv_id, n (from 0), role, text."""
        return self._rows().select(_unkeyed(F.col("ck"), self.kind).alias("conv_id"), "n", "role", "text")

    def digests(self) -> DataFrame:
        """(ck, repaired_sha256) of repaired conversations that have rows: SHA-256 of ``role:text`` lines."""
        return self._rows().mapInArrow(_digests, "ck string, repaired_sha256 string")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repairs of all damaged ``conversations``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    repair = Repair(damaged(rows), copies="copies")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = rows.select(_key(F.col("conv_id")).alias("ck")).distinct()
    out = every.join(repair._audits(), "ck", "left").join(repair.digests(), "ck", "left")
    return out.select(
        _unkeyed(F.col("ck"), repair.kind).alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


OP13_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                         lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 20 AS kind
  FROM conversations, tab),
dam AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM raw WHERE kind <> 0),
num AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(length(role), ':', role, text)), copy) AS t,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, regexp_matches(text, '[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z') AS trunc FROM dam),
rw AS MATERIALIZED (
  SELECT conv_id, turn, role, text, t, blank, again AND NOT blank AS dup, trunc AND NOT blank AND NOT again AS trunc, blank OR again AS gone,
         CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '-' END AS r FROM num),
chain(q, p, said, c) AS (VALUES (0, 0, '', 0), (0, 2, 'I', 5), (0, 3, 'II', 10), (1, 1, '', 0), (1, 2, 'I', 5), (1, 3, 'II', 10), (2, 2, '', 0), (2, 3, 'I', 5), (3, 3, '', 0), (3, 2, 'I', 5)),
op(p, z, letter, r, c) AS (
  VALUES (0, 0, 'D', '*', 2), (1, 1, 'D', '*', 2), (2, 2, 'D', '*', 2), (3, 3, 'D', '*', 2), (0, 1, 'K', 's', 0), (0, 2, 'K', 'u', 0), (1, 2, 'K', 'u', 0), (3, 2, 'K', 'u', 0), (2, 3, 'K', 'a', 0),
         (0, 2, 'R', '*', 1), (1, 2, 'R', '*', 1), (3, 2, 'R', '*', 1), (2, 3, 'R', '*', 1)),
arc AS (SELECT q, z, said || letter AS said, letter, r, chain.c + op.c AS c FROM chain JOIN op ON chain.p = op.p),
dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS t, 0 AS q, CAST(0 AS BIGINT) AS cost, '' AS audit FROM (SELECT DISTINCT conv_id FROM rw)
  UNION ALL
  SELECT conv_id, t, q, cost, audit FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) AS n FROM (
      SELECT dp.conv_id, rw.t, z AS q, dp.cost + arc.c + CASE WHEN trunc AND letter <> 'D' THEN 5 ELSE 0 END AS cost, dp.audit || arc.said AS audit
      FROM dp JOIN rw ON rw.conv_id IS NOT DISTINCT FROM dp.conv_id AND rw.t = dp.t + 1 JOIN arc ON arc.q = dp.q AND (letter = 'D' OR NOT gone) AND arc.r IN ('*', rw.r)))
  WHERE n = 1),
ends AS (
  SELECT conv_id, cost + c AS cost, audit || said AS audit FROM dp JOIN chain ON chain.q = dp.q AND p IN (0, 3)
  WHERE dp.t = (SELECT max(t) FROM rw WHERE rw.conv_id IS NOT DISTINCT FROM dp.conv_id)),
best AS MATERIALIZED (SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1),
letter AS (SELECT conv_id, audit, unnest(string_split(audit, '')) AS l, unnest(range(len(audit))) AS i FROM best WHERE audit <> ''),
place AS (
  SELECT conv_id, l, i, sum(CASE WHEN l <> 'I' THEN 1 ELSE 0 END) OVER w AS t, sum(CASE WHEN l <> 'D' THEN 1 ELSE 0 END) OVER w - 1 AS n,
         len(replace(audit, 'D', '')) % 2 AS shift FROM letter WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
text AS (
  SELECT place.conv_id, sha256(string_agg(concat(CASE WHEN l = 'K' THEN rw.role WHEN (n - shift) % 2 = 0 THEN 'user' ELSE 'assistant' END, ':', CASE WHEN l = 'I' THEN '' ELSE rw.text END), chr(10) ORDER BY i)) AS sha
  FROM place LEFT JOIN rw ON rw.conv_id IS NOT DISTINCT FROM place.conv_id AND rw.t = place.t WHERE l <> 'D' GROUP BY place.conv_id),
pair AS (SELECT conv_id, count(*) AS illegal FROM (SELECT conv_id, r || lead(r) OVER (PARTITION BY conv_id ORDER BY t) AS rr FROM rw) WHERE rr NOT IN ('su', 'ua', 'au') GROUP BY conv_id),
cnt AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(dup) AS duplicate, count_if(trunc) AS truncated FROM rw GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS o LEFT JOIN cnt ON cnt.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN pair ON pair.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN text ON text.conv_id IS NOT DISTINCT FROM o.conv_id
"""
