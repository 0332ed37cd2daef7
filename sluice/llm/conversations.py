"""Conversation repair: cheapest edits by Four-Russians block tables.

A repaired conversation has role initials ``(s?(ua)+)?``. Walking over its rows is a walk over four states
(nothing yet, after s, after u, after a); a cost vector holds the cheapest edits that lead to each. Less its
smallest entry, a vector is one of few, so two tables hold everything: what one row's symbol makes of each
vector, and what every block of ``BLOCK`` symbols does. Conversations are processed block by block by lookup;
the vectors at block borders are kept. Blocks are then expanded backward into vectors of single rows, and the
states that lie on some cheapest path are marked there. A last walk forward takes at each step the edit of the
smallest initial that stays on marked states, which gives the ASCII-least of all cheapest audits.

Spark's part: rows are damaged by expressions, sorted over all conversations by a range partitioning and
written, so that a long conversation lies in several partitions and its rows have running numbers. Symbols
gather by stretches of ``STRETCH`` rows and then by conversation, one byte a row (the audit, a value of the
result, is as long). Edits go back to the rows by stretch. The digest of a repaired conversation is one
sequential hash by definition: its rows stream sorted through one task, which holds one batch of them.

Defined cases: a null id is a conversation of its own; null turns come first; a null role or text is one
space, so such a text is blank and such a role cannot be kept. Rows of one turn follow each other by role
and text; repeated rows are duplicates of the first. Roles count by their first character; an empty role
has none. An empty table gives no rows; a conversation without rows after damage has zeros, an empty audit
and the digest of an empty text. Only ``conv_id, turn, role, text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.base import stage

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
BLOCK = 4
STRETCH = 4096
#: symbols of a row: must go; else its initial (s, u, a, other) and, four further on, truncated as well; none (padding)
GONE, PAD, SYMBOLS = 0, 9, 10
FAR = 1 << 20
#: state after an s, a u, an a; the state an inserted or reroled row leads to from each state
_EMITS = {0: "u", 1: "u", 2: "a", 3: "u"}
_NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
_LAST = (0, 3)


def _row_edges(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """``(initial, next state, cost)`` of the edits of one row, insertions aside."""
    if symbol == PAD:
        return [("", state, 0)]
    edges = [("D", state, DELETE)]
    if symbol != GONE:
        late = TRUNCATED if symbol > 4 else 0
        kind = "suao"[(symbol - 1) % 4]
        if kind == "s" and state == 0:
            edges.append(("K", 1, late))
        elif kind == _EMITS[state]:
            edges.append(("K", _NEXT[state], late))
        edges.append(("R", _NEXT[state], REROLE + late))
    return edges


def _insertions(v: list[int]) -> list[int]:
    """Cheapest costs once rows may be inserted (two in a row reach every state there is)."""
    v = list(v)
    for _ in range(2):
        for s in range(4):
            v[_NEXT[s]] = min(v[_NEXT[s]], v[s] + INSERT)
    return v


def _normal(v: list[int]) -> tuple[tuple[int, ...], int]:
    """The vector less its smallest entry, without states that no cheapest path uses: the state 'a' can
    follow any continuation of 'nothing' at 2 more (it deletes an s) and any of 's' at none."""
    least = min(v)
    if v[0] > v[3] + DELETE:
        v[0] = FAR
    if v[1] > v[3]:
        v[1] = FAR
    return tuple(x - least if x < FAR else FAR for x in v), least


class Tables:
    """All transitions of normalised cost vectors: by one symbol, by a block, and for tracing."""

    def __init__(self, block: int = BLOCK) -> None:
        first, _ = _normal(_insertions([0, FAR, FAR, FAR]))
        numbers, vectors, step, gain = {first: 0}, [first], [], []
        for v in vectors:       # grows while new vectors turn up
            row, added = [], []
            for symbol in range(SYMBOLS):
                out = [FAR] * 4
                for s in range(4):
                    for _, to, cost in _row_edges(symbol, s):
                        if v[s] < FAR:
                            out[to] = min(out[to], v[s] + cost)
                n, least = _normal(_insertions(out))
                if n not in numbers:
                    numbers[n] = len(vectors)
                    vectors.append(n)
                row.append(numbers[n])
                added.append(least)
            step.append(row)
            gain.append(added)
        self.vectors = np.array(vectors)
        self.step, self.gain = np.array(step), np.array(gain)
        # blocks: the number of a block has its first symbol as its highest digit
        self.block = block
        to = np.arange(len(vectors))[:, None]
        cost = np.zeros((len(vectors), 1), dtype=np.int64)
        for _ in range(block):
            cost = (cost[:, :, None] + self.gain[to]).reshape(len(vectors), -1)
            to = self.step[to].reshape(len(vectors), -1)
        self.block_step, self.block_gain = to, cost
        self._trace_tables()

    def _trace_tables(self) -> None:
        """``mask[v, symbol, later]``: states on a cheapest path before a row, given those after it (bits).
        ``walk[v, symbol, later, state]``: number of the piece of the audit that the row adds (insertions before
        it included), and ``state`` after it. ``end[v, state]``: insertions after the last row."""
        n = len(self.vectors)
        self.pieces: list[tuple[str, str]] = []     # audit letters; roles of inserted rows and of the row ('' as it is)
        known: dict[tuple[str, str], int] = {}
        self.mask = np.zeros((n, SYMBOLS, 16), dtype=np.uint8)
        self.walk = np.zeros((n, SYMBOLS, 16, 4), dtype=np.uint8)
        self.after = np.zeros((n, SYMBOLS, 16, 4), dtype=np.uint8)
        self.last = np.zeros(n, dtype=np.uint8)
        self.left_at_end = np.zeros(n, dtype=np.int64)
        self.end = np.zeros((n, 4), dtype=np.uint8)

        def number(letters: str, roles: str) -> int:
            if (letters, roles) not in known:
                known[letters, roles] = len(self.pieces)
                self.pieces.append((letters, roles))
            return known[letters, roles]

        def widen(v, marked: int) -> int:
            for _ in range(2):
                for s in range(4):
                    if v[s] < FAR and marked >> _NEXT[s] & 1 and v[s] + INSERT == v[_NEXT[s]]:
                        marked |= 1 << s
            return marked

        for i, v in enumerate(self.vectors.tolist()):
            self.left_at_end[i] = min(v[s] for s in _LAST)
            self.last[i] = widen(v, sum(1 << s for s in _LAST if v[s] == self.left_at_end[i]))
            for s in range(4):
                roles, at = "", s
                while self.last[i] >> s & 1 and not (at in _LAST and v[at] == self.left_at_end[i]):
                    roles += _EMITS[at]
                    at = _NEXT[at]
                self.end[i, s] = number("I" * len(roles), roles)
            for symbol in range(SYMBOLS):
                w, base = self.vectors[self.step[i, symbol]], self.gain[i, symbol]
                for later in range(16):
                    # edges that are on a cheapest path: they reach a marked state at its cost
                    good = [[(e, to) for e, to, cost in _row_edges(symbol, s) if v[s] < FAR and later >> to & 1
                             and w[to] < FAR and v[s] + cost == w[to] + base] for s in range(4)]
                    marked = widen(v, sum(1 << s for s in range(4) if good[s]))
                    self.mask[i, symbol, later] = marked
                    for s in range(4):
                        if not marked >> s & 1:
                            continue
                        roles, at, letters = "", s, ""
                        while True:
                            here = sorted(good[at])
                            onward = v[at] + INSERT == v[_NEXT[at]] and marked >> _NEXT[at] & 1
                            if here and (here[0][0] in ("", "D") or not onward):
                                e, to = here[0]
                                break
                            letters += "I"
                            roles += _EMITS[at]
                            at = _NEXT[at]
                        made = roles + ("" if e in ("", "D") else "k" if e == "K" else _EMITS[at].upper())
                        self.walk[i, symbol, later, s] = number(letters + e, made)
                        self.after[i, symbol, later, s] = to


@lru_cache(maxsize=2)
def tables(block: int = BLOCK) -> Tables:
    return Tables(block)


def repair(symbols: list[np.ndarray], block: int = BLOCK) -> list[tuple[int, list[int], int]]:
    """For each conversation's symbols: the cost, the number of every row's piece, and of the last piece."""
    t = tables(block)
    out: list = [None] * len(symbols)
    # conversations of alike length go together, so that padding stays below one part in two
    lengths = np.array([len(s) for s in symbols], dtype=np.int64)
    group = np.ceil(np.log2(np.maximum(lengths, 1) / block + 1)).astype(int)
    for g in np.unique(group):
        members = np.flatnonzero(group == g)
        for at in range(0, len(members), 4096):
            part = members[at:at + 4096]
            blocks = int(-(-lengths[part].max() // block))
            grid = np.full((len(part), blocks * block), PAD, dtype=np.uint8)
            for row, m in enumerate(part):
                grid[row, :lengths[m]] = symbols[m]
            cost, pieces, ends = _repair_grid(grid, t)
            for row, m in enumerate(part):
                out[m] = (int(cost[row]), pieces[row, :lengths[m]], int(ends[row]))
    return out


def _repair_grid(grid: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, width = grid.shape
    blocks = width // t.block
    number = np.zeros((n, blocks), dtype=np.int64)
    for j in range(t.block):
        number = number * SYMBOLS + grid[:, j::t.block]
    # forward by blocks; the vectors at their borders stay
    border = np.zeros((n, blocks + 1), dtype=np.int64)
    cost = np.zeros(n, dtype=np.int64)
    for b in range(blocks):
        cost += t.block_gain[border[:, b], number[:, b]]
        border[:, b + 1] = t.block_step[border[:, b], number[:, b]]
    cost += t.left_at_end[border[:, blocks]]
    # backward: each block unfolds into the vectors of its rows, and marks go from its end to its start
    marks = np.zeros((n, width + 1), dtype=np.uint8)
    marks[:, width] = t.last[border[:, blocks]]
    vector = np.zeros((n, width), dtype=np.int64)
    for b in range(blocks - 1, -1, -1):
        v = border[:, b]
        for i in range(b * t.block, (b + 1) * t.block):
            vector[:, i] = v
            v = t.step[v, grid[:, i]]
        for i in range((b + 1) * t.block - 1, b * t.block - 1, -1):
            marks[:, i] = t.mask[vector[:, i], grid[:, i], marks[:, i + 1]]
    # forward along marked states
    pieces = np.zeros((n, width), dtype=np.uint8)
    state = np.zeros(n, dtype=np.int64)
    for i in range(width):
        at = vector[:, i], grid[:, i], marks[:, i + 1], state
        pieces[:, i] = t.walk[at]
        state = t.after[at]
    return cost, pieces, t.end[border[:, blocks], state]


# ---- Spark ------------------------------------------------------------------------------

def _spaced(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, ck, role, text`` of the rows after damage (``ck``: the id as text)."""
    kind = F.crc32(F.concat_ws(":", _spaced("conv_id"), _spaced("turn"))) % 20
    rows = conversations.select("conv_id", "turn", _spaced("conv_id").alias("ck"), _spaced("role").alias("role"),
                                _spaced("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    copies = F.when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select(
        "conv_id", "turn", "ck", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).drop("copy")


_SPACE = "\\x20\\x09-\\x0D"


def _symbols(rows: DataFrame) -> DataFrame:
    """``ord, ck, conv_id, turn, initial, fault, symbol`` of the sorted rows."""
    key = F.sha2(F.concat_ws("\u0001", F.length("role").cast("string"), "role", "text"), 256)
    marked = rows.select("ord", "ck", "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), key.alias("same"),
                         (~F.col("text").rlike(f"[^{_SPACE}]")).alias("blank"),
                         (~F.col("text").rlike(f"[.!?][{_SPACE}]*\\z")).alias("cut"))
    firsts = marked.groupBy("ck", "same").agg(F.min("ord").alias("ord")).select("ord", F.lit(True).alias("first"))
    fault = (F.when(F.col("blank"), F.lit("b")).when(F.col("first").isNull(), F.lit("d"))
             .when(F.col("cut"), F.lit("t")).otherwise(F.lit("")))
    known = marked.join(firsts, "ord", "left").withColumn("fault", fault)
    kind = F.when(F.col("initial") == "s", 1).when(F.col("initial") == "u", 2).when(F.col("initial") == "a", 3).otherwise(4)
    symbol = F.when(F.col("fault").isin("b", "d"), F.lit(GONE)).when(F.col("fault") == "t", kind + 4).otherwise(kind)
    return known.select("ord", "ck", "conv_id", "turn", kind.alias("kind"), "fault", symbol.cast("int").alias("symbol"))


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of each conversation's rows to its cost, audit and illegal pairs, and one row a stretch
    with the pieces of its rows."""
    t = tables()
    letters = [a for a, _ in t.pieces]
    for batch in batches:
        rows = batch.to_pylist()
        symbols, sizes = [], []
        for r in rows:
            parts = [np.frombuffer(s["symbols"].encode("ascii"), np.uint8) - 48 for s in r["stretches"]]
            sizes.append([len(p) for p in parts])
            symbols.append(np.concatenate(parts).astype(np.uint8))
        out = []
        for r, size, (cost, pieces, end) in zip(rows, sizes, repair(symbols)):
            kinds = np.concatenate([np.frombuffer(s["kinds"].encode("ascii"), np.uint8) - 48 for s in r["stretches"]])
            pair = kinds[:-1] * 10 + kinds[1:]
            audit = "".join([letters[p] for p in pieces.tolist()]) + letters[end]
            at = np.cumsum([0, *size])
            out.append({"ck": r["ck"], "cost": cost, "illegal": int(len(pair) - np.isin(pair, (12, 23, 32)).sum()),
                        "audit": audit, "end": end,
                        "stretches": [{"stretch": s["stretch"], "pieces": pieces[a:b].tobytes()}
                                      for s, a, b in zip(r["stretches"], at[:-1], at[1:])]})
        yield pa.RecordBatch.from_pylist(out, schema=_REPAIRED)


_REPAIRED = pa.schema([("ck", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64()), ("audit", pa.string()),
                       ("end", pa.int32()), ("stretches", pa.list_(pa.struct([("stretch", pa.int64()), ("pieces", pa.binary())])))])
_REPAIRED_SQL = "ck string, cost long, illegal long, audit string, end int, stretches array<struct<stretch: long, pieces: binary>>"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and place, each with its piece: the digest of each repaired text."""
    made = [roles for _, roles in tables().pieces]
    names = {"u": "user", "a": "assistant"}
    key, state, begun, done = None, None, False, []

    def line(role: str, text: str) -> None:
        nonlocal begun
        state.update((("\n" if begun else "") + role + ":" + text).encode())
        begun = True

    for batch in batches:
        for ck, role, text, piece in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if state is None or ck != key:
                if state is not None:
                    done.append((key, state.hexdigest()))
                key, state, begun = ck, hashlib.sha256(), False
            for c in made[piece]:
                if c in names:
                    line(names[c], "")
                else:
                    line(role if c == "k" else names[c.lower()], text)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in done]), pa.array([b for _, b in done])], names=["ck", "repaired_sha256"])
            done = []
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], names=["ck", "repaired_sha256"])


def repair_rows(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sorted damaged rows, their symbols, and each conversation's repair (all staged)."""
    order = [F.col(c).asc_nulls_first() for c in ("ck", "turn", "role", "text")]
    # the last key spreads rows that are equal in all others; equal rows may follow each other in any order
    spread = damage(conversations).withColumn("nth", F.monotonically_increasing_id())
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stage(spread.repartitionByRange(parts, *order, F.col("nth")).sortWithinPartitions(*order, "nth")
                 .drop("nth").withColumn("ord", F.monotonically_increasing_id()), "conversation-rows")
    symbols = stage(_symbols(rows), "symbols")
    text = lambda c: F.array_join(F.transform(F.array_sort("all"), lambda x: x[c].cast("string")), "")
    stretches = (symbols.groupBy("ck", F.expr(f"ord div {STRETCH}").alias("stretch"))
                 .agg(F.collect_list(F.struct("ord", "symbol", "kind")).alias("all"))
                 .select("ck", "stretch", text("symbol").alias("symbols"), text("kind").alias("kinds")))
    gathered = (stretches.groupBy("ck").agg(F.array_sort(F.collect_list(F.struct("stretch", "symbols", "kinds"))).alias("stretches")))
    return rows, symbols, stage(gathered.mapInArrow(_repairs, _REPAIRED_SQL), "repairs")


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """One row a conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``."""
    rows, symbols, repairs = repair_rows(conversations)
    first = symbols.groupBy("ck", F.expr(f"ord div {STRETCH}").alias("stretch")).agg(F.min("ord").alias("low"))
    edits = (repairs.select("ck", F.explode("stretches").alias("s")).select("ck", "s.*").join(first, ["ck", "stretch"]))
    numbered = rows.withColumn("stretch", F.expr(f"ord div {STRETCH}")).join(edits, ["ck", "stretch"])
    byte = F.conv(F.hex(F.expr("substring(pieces, cast(ord - low as int) + 1, 1)")), 16, 10).cast("int")
    lines = numbered.select("ck", "ord", "role", "text", byte.alias("piece"))
    ends = repairs.join(symbols.groupBy("ck").agg(F.max("ord").alias("ord")), "ck").select(
        "ck", (F.col("ord") + 1).alias("ord"), F.lit("").alias("role"), F.lit("").alias("text"), F.col("end").alias("piece"))
    digests = (lines.unionByName(ends).repartition("ck").sortWithinPartitions("ck", "ord").drop("ord")
               .mapInArrow(_digests, "ck string, repaired_sha256 string"))
    count = lambda f: F.count_if(F.col("fault") == f)
    turns = symbols.groupBy("ck", "turn").agg(count("b").alias("b"), count("d").alias("d"), count("t").alias("t"))
    facts = turns.groupBy("ck").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
        F.sum("b").alias("blank"), F.sum("d").alias("duplicate"), F.sum("t").alias("truncated"))
    all_ids = conversations.select("conv_id", _spaced("conv_id").alias("ck")).distinct()
    nothing = hashlib.sha256().hexdigest()
    joined = all_ids.join(facts, "ck", "left").join(repairs.drop("stretches", "end"), "ck", "left").join(digests, "ck", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return joined.select("conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                         F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def oracle() -> str:
    """The cheapest edits by plain dynamic programming over rows, all ties kept until the end."""
    space = r"\x20\x09-\x0D"
    crc = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)), "
           "lambda c, b: list_reduce([xor(c, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT)")
    counts = ", ".join(f"count(*) FILTER (WHERE fault = '{f}') AS {n}" for f, n in (("b", "blank"), ("d", "duplicate"), ("t", "truncated")))
    zeros = ", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    add = "CASE WHEN {out} IS NULL THEN {line} ELSE {out} || chr(10) || {line} END"
    return rf"""
        WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(conv_id::VARCHAR, ' ') AS ck, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                                    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
        m AS (SELECT *, {crc} % 20 AS kind FROM c),
        d AS (SELECT turn, ck, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                     CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                     unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM m WHERE kind <> 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY ck ORDER BY turn NULLS FIRST, role, text, copy) AS i,
                     row_number() OVER (PARTITION BY ck, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM d),
        f AS MATERIALIZED (SELECT ck, i, turn, role, text, left(role, 1) AS ini, CASE WHEN NOT regexp_matches(text, '[^{space}]') THEN 'b' WHEN nth > 1 THEN 'd'
                     WHEN NOT regexp_matches(text, '[.!?][{space}]*$') THEN 't' ELSE '' END AS fault FROM o),
        e(s, emit, name, s2) AS (VALUES (0, 'u', 'user', 2), (1, 'u', 'user', 2), (2, 'a', 'assistant', 3), (3, 'u', 'user', 2)),
        n(s, s3, price, letters, lines) AS (VALUES (0, 0, 0, '', NULL), (1, 1, 0, '', NULL), (2, 2, 0, '', NULL), (3, 3, 0, '', NULL),
             (0, 2, 5, 'I', 'user:'), (1, 2, 5, 'I', 'user:'), (2, 3, 5, 'I', 'assistant:'), (3, 2, 5, 'I', 'user:'),
             (0, 3, 10, 'II', 'user:' || chr(10) || 'assistant:'), (1, 3, 10, 'II', 'user:' || chr(10) || 'assistant:')),
        r AS (SELECT ck, 0::BIGINT AS i, s3 AS s, price AS cost, letters AS audit, lines AS made FROM (SELECT DISTINCT ck FROM f), n WHERE n.s = 0
              UNION ALL
              SELECT * FROM (
                SELECT DISTINCT x.ck, x.i, n.s3 AS s, x.cost + n.price AS cost, x.audit || n.letters AS audit,
                       CASE WHEN n.lines IS NULL THEN x.made ELSE {add.format(out="x.made", line="n.lines")} END AS made
                FROM (SELECT r.ck, f.i, CASE op WHEN 'D' THEN r.s WHEN 'S' THEN 1 ELSE e.s2 END AS s,
                             r.cost + CASE op WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN op <> 'D' AND fault = 't' THEN 5 ELSE 0 END AS cost,
                             r.audit || CASE op WHEN 'S' THEN 'K' ELSE op END AS audit,
                             CASE WHEN op = 'D' THEN r.made ELSE {add.format(out="r.made", line="(CASE WHEN op = 'R' THEN e.name ELSE f.role END || ':' || f.text)")} END AS made
                      FROM r JOIN f ON f.ck = r.ck AND f.i = r.i + 1 JOIN e ON e.s = r.s, (VALUES ('D'), ('K'), ('S'), ('R')) t(op)
                      WHERE op = 'D' OR (fault NOT IN ('b', 'd') AND (op = 'R' OR (op = 'S' AND ini = 's' AND r.s = 0) OR (op = 'K' AND ini = e.emit)))) x
                JOIN n ON n.s = x.s)
              QUALIFY rank() OVER (PARTITION BY ck, s ORDER BY cost) = 1),
        z AS (SELECT r.* FROM r JOIN (SELECT ck, max(i) AS i FROM f GROUP BY ck) USING (ck, i) WHERE s IN (0, 3)
              QUALIFY row_number() OVER (PARTITION BY ck ORDER BY cost, audit) = 1),
        p AS (SELECT ck, ini || lead(ini) OVER (PARTITION BY ck ORDER BY i) AS pair FROM f),
        g AS (SELECT ck, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, {counts} FROM f GROUP BY ck),
        l AS (SELECT ck, count(*) AS illegal FROM p WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au') GROUP BY ck)
        SELECT a.conv_id, {zeros}, coalesce(audit, '') AS audit, sha256(coalesce(made, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id, ck FROM c) a LEFT JOIN g USING (ck) LEFT JOIN l USING (ck) LEFT JOIN z USING (ck)"""
