"""Mixing sources to target weights by cube-method balanced sampling.

Sources (by code point, null last) weigh 5, 2, 1, repeating, and share the size of the whole
corpus; no target passes ``MOST`` times its source's size, and what is cut off is shared again by
weight. The few documents that hold over 1 / ``LARGE`` of their source are settled first, one
after the other. For the rest, a source's rate (words owed / words left) gives each of its documents a whole number of copies and
a fractional inclusion probability for one more.

The flight phase moves these fractions through the null space of two constraints (tokens and
documents of the source): among any three undecided documents some direction leaves both totals
unchanged, and moving along it until a bound is met decides one of them. Long documents come
first, so those left for the landing are short. Sources are split into
blocks (a hot source into many), each flown on its own; the undecided rest, at most two
documents a block, is gathered and flown again, level by level, until one block a source is left.
Its last documents are landed together, on the choice nearest to the source's token target.

Every choice comes from hashes of (doc_id, text) and the data, so reruns agree. Defined cases: null
and empty texts have size 0 and take no words (they join the count constraint only); a source
without words has target 0. Rows that repeat a doc_id are separate units, each with its own text's copies; equal
sizes and hashes tie to the earlier repeat. Texts of any length count whole, and extra columns may have any name. Only ``doc_id``,
``text`` and ``source`` are read by :func:`mix_plan`. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.base import sized, stage

WEIGHTS = (5, 2, 1)
MOST = 3
#: documents that one flight task takes
BLOCK = 20_000
#: documents over 1 / LARGE of their source's size are decided before the flights
LARGE = 200
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text="text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source, source_no, source_size, target, units`` from ``source, size`` rows.

    One row a source; the level at which weights are paid is found by a few one-row sums."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("units"))
    # a running number over the distinct sources only, not over documents
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    s = stage(totals.withColumn("source_no", rank).withColumn(
        "weight", F.get(weights, (F.col("source_no") - 1) % len(WEIGHTS))), "sources")
    whole = s.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, None
    while True:
        below = F.col("weight") * level < MOST * F.col("source_size")
        got = s.agg(F.coalesce(F.sum(F.when(~below, MOST * F.col("source_size"))), F.lit(0)).alias("capped"),
                    F.coalesce(F.sum(F.when(below, F.col("weight"))), F.lit(0.0)).alias("weight"),
                    F.count_if(~below).alias("n")).first()
        if got["weight"] == 0 or (full is not None and got["n"] == full):
            break
        full = got["n"]
        level = (whole - got["capped"]) / got["weight"]
    return s.withColumn("target", F.least(F.col("weight") * F.lit(level), (MOST * F.col("source_size")).cast("double")))


def fly(prob: np.ndarray, size: np.ndarray, mark: np.ndarray | None = None, eps: float = 1e-9) -> np.ndarray:
    """Flight phase over one block: probabilities after it, all but two or so at 0 or 1. ``mark`` are the
    documents' hashes, from which moves are drawn (their places if none are given)."""
    p = prob.tolist()
    s = size.tolist()
    h = list(range(len(p))) if mark is None else mark.tolist()
    held: list[int] = []
    for i in range(len(p)):
        if not eps < p[i] < 1 - eps:
            p[i] = round(p[i])
            continue
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        # null space of [[s_a s_b s_c], [1 1 1]] in the moves of the probabilities
        u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
        if u == (0, 0, 0):
            u = (1, -1, 0)
        up = down = float("inf")
        for k, v in zip(held, u):
            if v > 0:
                up, down = min(up, (1 - p[k]) / v), min(down, p[k] / v)
            elif v < 0:
                up, down = min(up, p[k] / -v), min(down, (1 - p[k]) / -v)
        # the end that keeps expectations is drawn with odds down : up, by a hash of the three
        draw = ((h[a] ^ h[b] * 40503 ^ h[c] * 97) * 0x9E3779B97F4A7C15 >> 11 & (1 << 53) - 1) / (1 << 53)
        step = up if draw * (up + down) < down else -down
        rest = []
        for k, v in zip(held, u):
            p[k] = min(1.0, max(0.0, p[k] + step * v))
            if p[k] <= eps or p[k] >= 1 - eps:
                p[k] = float(round(p[k]))
            else:
                rest.append(k)
        held = rest
    return np.array(p)


def land(prob: np.ndarray, size: np.ndarray, miss: float) -> np.ndarray:
    """Decide the last undecided documents: the choice whose tokens come nearest to ``miss``
    (the tokens still owed), then to the expected count."""
    open_ = np.flatnonzero((prob > 0) & (prob < 1))
    out = prob.copy()
    best = None
    for mask in range(1 << len(open_)):
        pick = [(mask >> k) & 1 for k in range(len(open_))]
        off = abs(sum(x * float(size[i]) for x, i in zip(pick, open_)) - miss)
        key = (off, abs(sum(pick) - prob[open_].sum()), mask)
        if best is None or key < best[0]:
            best = (key, pick)
    out[open_] = best[1]
    return out


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    """Copies of a source's largest documents, one after the other: each takes the rate that the
    words still owed ask for, rounded up or down by a hash, so that what is left can still be met."""
    pdf = pdf.sort_values(["size", "mark", "rep"], ascending=[False, True, True], kind="stable")
    owed, left = float(pdf["target"].iloc[0]), int(pdf["source_size"].iloc[0])
    copies = []
    for size, mark in zip(pdf["size"].tolist(), pdf["mark"].tolist()):
        rate = min(float(MOST), max(0.0, owed / left)) if left else 0.0
        low = min(int(rate), MOST)
        left -= size
        fits = [c for c in (low, low + 1) if c <= MOST and 0 <= owed - c * size <= MOST * left]
        if len(fits) == 1:
            c = fits[0]
        elif fits:
            c = low + ((mark * 0x9E3779B97F4A7C15 >> 11 & (1 << 53) - 1) / (1 << 53) < rate - low)
        else:
            c = min((low, min(low + 1, MOST)), key=lambda c: abs(owed - c * size - min(max(owed - c * size, 0), MOST * left)))
        owed -= c * size
        copies.append(c)
    return pdf.assign(copies=copies)[["unit", "source_no", "size", "copies"]]


def _flight(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["size", "mark", "rep"], ascending=[False, True, True], kind="stable")
    pdf["prob"] = fly(pdf["prob"].to_numpy(), pdf["size"].to_numpy(), pdf["mark"].to_numpy())
    return pdf.drop(columns=["block"])


def _landing(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["size", "mark", "rep"], ascending=[False, True, True], kind="stable")
    prob, size = pdf["prob"].to_numpy(), pdf["size"].to_numpy()
    after = fly(prob, size, pdf["mark"].to_numpy())
    owed = float((prob * size).sum()) - float((np.where(after == 1, 1.0, 0.0) * size).sum())
    pdf["prob"] = land(after, size, owed + float(pdf["owed"].iloc[0]))
    return pdf.drop(columns=["block", "owed"])


def mix_plan(documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """``doc_id, size, source_size, target, taken, source, copies`` for every row."""
    return _plan(documents, block).drop("mark", "rep")


def _mark():
    """A hash of (doc_id, text): with the source it names a row, up to rows equal in all three."""
    return F.xxhash64("doc_id", "text", F.lit(20240105))


def _plan(documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """:func:`mix_plan` with each row's ``mark``, and ``rep`` from 1 among rows of equal id, text and source."""
    # identical rows are counted and dealt out again under running numbers: no order, no hot key
    units = (documents.select("doc_id", "source", word_count().alias("size"), _mark().alias("mark"))
             .groupBy("doc_id", "source", "size", "mark").agg(F.count("*").alias("m")))
    units = stage(units.select("doc_id", "source", "size", "mark",
                               F.explode(F.sequence(F.lit(1), F.col("m"))).alias("rep")), "sizes")
    sources = stage(source_targets(units), "targets")
    key = sources.select(F.col("source").alias("_s"), "source_no", "source_size", "units", "target")
    every = stage(units.join(sized(key), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
                  .withColumn("unit", F.monotonically_increasing_id()), "every")
    # a source's largest documents (at most LARGE of them) first; the rest makes up what they miss
    large = F.col("size") * LARGE > F.col("source_size")
    settled = stage(every.where(large).select("mark", "rep", "size", "source_no", "source_size", "target", "unit")
                    .groupBy("source_no").applyInPandas(_settle, "unit long, source_no int, size long, copies int"), "large")
    used = stage(settled.groupBy("source_no").agg(F.sum("size").alias("held"),
                                                  F.sum(F.col("size") * F.col("copies")).alias("used")), "used")
    rest = every.where(~large).join(sized(used), "source_no", "left").fillna(0, ["held", "used"])
    rate = F.when(F.col("source_size") > F.col("held"), F.least(F.lit(float(MOST)), F.greatest(F.lit(0.0), (
        F.col("target") - F.col("used")) / (F.col("source_size") - F.col("held"))))).otherwise(0.0)
    rows = rest.withColumn("rate", rate).withColumn("base", F.floor(F.col("rate") + 1e-12))
    rows = stage(rows.withColumn("prob", F.greatest(F.lit(0.0), F.col("rate") - F.col("base"))), "units")

    # flights: blocks of bounded size, then the undecided rest, until one block a source is left
    schema = "size long, mark long, rep long, source_no int, unit long, prob double"
    todo = rows.select("size", "mark", "rep", "source_no", "unit", "prob").where("prob > 1e-9 and prob < 1 - 1e-9")
    done = rows.select("unit", F.when(F.col("prob") >= 1 - 1e-9, 1.0).otherwise(0.0).alias("prob")).where("false")
    round_no = 0
    while True:
        counts = stage(todo.groupBy("source_no").agg(F.ceil(F.count("*") / F.lit(block)).alias("blocks")), "blocks")
        if (counts.agg(F.max("blocks")).first()[0] or 0) <= 1:
            break
        cut = todo.join(sized(counts), "source_no").withColumn(
            "block", F.pmod(F.xxhash64("mark", "rep", F.lit(round_no)), "blocks")).drop("blocks")
        flown = stage(cut.select("size", "mark", "rep", "source_no", "unit", "prob", "block")
                      .groupBy("source_no", "block").applyInPandas(_flight, schema), "flight")
        done = done.unionByName(flown.where("prob <= 0 or prob >= 1").select("unit", "prob"))
        todo = flown.where("prob > 0 and prob < 1")
        round_no += 1
    # what the decided documents and rounding still owe their source, in words
    decided = rows.join(done.withColumnRenamed("prob", "x"), "unit").groupBy("source_no").agg(
        F.sum((F.col("prob") - F.col("x")) * F.col("size")).alias("before"))
    left = todo.join(rows.select("unit", F.col("prob").alias("first")), "unit").groupBy("source_no").agg(
        F.sum((F.col("first") - F.col("prob")) * F.col("size")).alias("moved"))
    owed = decided.join(left, "source_no", "full").select("source_no", (
        F.coalesce("before", F.lit(0.0)) + F.coalesce("moved", F.lit(0.0))).alias("owed"))
    last = (todo.join(sized(stage(owed, "owed")), "source_no", "left").fillna(0.0, ["owed"])
            .withColumn("block", F.lit(0)).groupBy("source_no").applyInPandas(_landing, schema))
    done = stage(done.unionByName(stage(last, "landing").select("unit", "prob")), "decided")
    more = rows.join(done.withColumnRenamed("prob", "x"), "unit", "left")
    copies = F.col("base") + F.when(F.col("x").isNotNull(), F.col("x").cast("int")).otherwise(
        (F.col("prob") >= 1 - 1e-9).cast("int"))
    names = ["doc_id", "size", "source_size", "target", "source", "copies", "mark", "rep"]
    out = more.withColumn("copies", F.least(F.lit(MOST), copies).cast("int")).select(*names).unionByName(
        every.where(large).join(settled.select("unit", "copies"), "unit").select(*names))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"),
                      "source", "copies", "mark", "rep")


def mix_documents(documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """``documents`` as the mix takes them: each row as often as its copies say, all columns kept.

    A row finds its plan by a hash of id and text, so several texts of one id keep their own. Rows of equal id,
    text and source are numbered by their other columns: each of their plans is used once, in any layout."""
    plan = stage(_plan(documents, block), "plan")
    takes = plan.where("copies > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("mark").alias("_mark"),
                                            F.col("rep").alias("_rep"), F.col("copies").alias("_copies"))
    docs = documents.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(documents.columns)],
                            F.col("doc_id"), F.col("source"), _mark().alias("mark"))
    if plan.where("rep > 1").isEmpty():
        docs = docs.withColumn("_n", F.lit(1))
    else:
        order = F.xxhash64(*[f"c{i}" for i in range(len(documents.columns))])
        docs = docs.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "source", "mark").orderBy(order)))
    met = docs.join(sized(stage(takes, "takes")), docs["doc_id"].eqNullSafe(F.col("_id"))
                    & docs["source"].eqNullSafe(F.col("_source"))
                    & (docs["mark"] == F.col("_mark")) & (F.col("_n") == F.col("_rep")))
    return (met.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
            .select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(documents.columns)]))
