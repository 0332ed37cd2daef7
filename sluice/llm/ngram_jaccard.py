"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds its distinct five-word shingles (ASCII lower case; a text of fewer
words is one shingle; no words, no set). Two documents link when
``100 * |A & B| >= 80 * |A | B|``.

1. Documents of equal sets form a class; one row of each class goes on.
2. Let t = ceil(0.8 n). Under any one order of shingles, linked documents share at least l
   shingles among the first n - t + l of each (l the smaller of their two levels). The first
   screen takes hash order and l = n // 16: a class with fewer shingles in its prefix that another
   prefix has too than its lowest possible partner demands goes. Of the others the whole sets are
   screened alike: t shingles must be in another of them. Shingles travel in 32 bits, dealt by the
   other 32 (a collision only keeps a class). This is linear, and passages shared by thousands of
   documents end here.
3. The survivors' shared shingles are ordered from rare to frequent. Each document then picks
   its own second level (1, 2, 4, ... 16): every step lengthens its prefix and raises the
   number of shared prefix shingles asked for, and the level with the least estimated cost
   (postings read + candidates left to verify) wins.
4. Every document is first verified against one pivot, the lowest document of the shingle
   buckets they share most; buckets that now lie in one component are closed. Within the others
   documents of different components are compared exactly: through shingles of at most ``HOT``
   documents as pairs that share enough of them, and through more frequent shingles in blocks,
   where matrix products count the overlaps and only a spanning forest of the links comes out.
   A group of thousands of near copies thus never becomes pairs of rows.

Defined cases: null or blank text: n_shingles 0, component_id = doc_id. Repeated rows are
separate rows of one class. A null doc_id is ignored in the minimum. Only ``doc_id`` and
``text`` are read, so extra columns of any name do no harm. An empty table gives no rows.
Texts of any length are whole, ties go to the smallest id.
Sets are compared by 64-bit shingle hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import bloom
from sluice.llm import words as W
from sluice.llm.base import BROADCAST_ROWS, components, give_back, has_repeats, one_row_each, sized, slices, stage, text_key

#: words of a shingle
K = 5
LEVELS = (1, 2, 4, 8, 16)
#: cost of verifying one candidate, in postings read per shingle of the document
VERIFY = 0.5
#: postings of a shingle beyond which its documents are compared in blocks
HOT = 24
#: documents of a block, and shingles counted by one matrix product
BLOCK = 512
COLUMNS = 4096
#: shingles for which one more part is dealt by a screen
PART_GRAMS = 1_000_000
#: rows whose shingles are dealt together; a number of one byte that none of them has
DEALT = 255


def need(n):
    """Smallest overlap any partner of a set of n can have: ceil(0.8 n)."""
    return (4 * n + 4) // 5


def level(n):
    """Matches asked for by the first screen; grows with n, so a partner's is at least
    ``level(need(n))``."""
    return np.maximum(1, n // 16)


def _sets(col, k: int):
    """Sorted distinct shingle hashes of each text."""
    for c in W.chunks(col, lower=True):
        g = W.grams(c.hashes, k)
        for d in range(c.docs):
            a, b = c.first[d], c.first[d + 1]
            if b - a >= k:
                yield np.unique(g[a:b - k + 1])
            elif b > a:
                yield W.mix((c.hashes[a:b] * W.GRAM[:b - a]).sum(dtype=np.uint64, keepdims=True)
                            + np.uint64(b - a))
            else:
                yield c.hashes[:0]


def _prefix_batches(k: int):
    def run(batches):
        for batch in slices(batches):
            n, s1, s2, pre = [], [], [], []
            for s in _sets(batch.column("text"), k):
                size = len(s)
                n.append(size)
                s1.append(W.signed(int(s.sum(dtype=np.uint64))))
                s2.append(W.signed(int(W.mix(s ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64))))
                pre.append(s[:size - need(size) + int(level(size))] if size else s)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tk1"), batch.column("tk2"), pa.array(n, pa.int64()),
                 pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), W.list_column(pre)],
                names=["doc_id", "tk1", "tk2", "n", "s1", "s2", "prefix"])
    return run


def _set_batches(k: int):
    def run(batches):
        for batch in slices(batches):
            sets = list(_sets(batch.column("text"), k))
            yield pa.RecordBatch.from_arrays([batch.column("node"), W.list_column(sets)], names=["node", "grams"])
    return run


def _dealt(parts: int):
    """The shingles of ``DEALT`` rows together, a row for each part that has some of them: their low 32 bits, and
    whose they are. Shingles that two of the rows have are counted here and sent once, for no row of these."""
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, DEALT):
                batch = whole.slice(at, DEALT)
                lists = batch.column("grams")
                grams = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                owner = np.repeat(np.arange(len(lists), dtype=np.uint8), np.diff(lists.offsets.to_numpy()))
                order = np.argsort(grams)
                grams, owner = grams[order], owner[order]
                first = np.ones(len(grams), dtype=bool)
                first[1:] = grams[1:] != grams[:-1]
                many = ~first
                many[:-1] |= ~first[1:]
                counted = owner[many].tobytes()
                grams, owner = grams[first], np.where(many, DEALT, owner)[first].astype(np.uint8)
                part, keys = bloom.split(grams, parts)
                order = np.argsort(part, kind="stable")
                part, keys, owner = part[order], keys[order].astype(np.uint32), owner[order]
                cuts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]]) if len(part) else [0]
                n = len(cuts) - 1
                # the rows themselves ride with their first part
                about = lambda x: pa.array([x, *[None] * (n - 1)][:n], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[cuts[:-1]], pa.int64()), pa.array([batch.column("node")[0].as_py()] * n, pa.int64()),
                     about(batch.column("node").to_numpy().tobytes()),
                     about(batch.column("least").cast(pa.int64()).to_numpy().tobytes()), about(counted),
                     pa.array([owner[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                     pa.array([keys[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())],
                    names=["part", "block", "nodes", "least", "counted", "owners", "keys"])
        give_back()
    return run


def _met(key, rows: pd.DataFrame) -> pd.DataFrame:
    """Whose the shingles of one part are that came more than once."""
    keys = [np.frombuffer(k, np.uint32) for k in rows["keys"]]
    ends = np.cumsum([len(k) for k in keys])
    flat = np.concatenate(keys)
    order = np.argsort(flat)
    again = flat[order[1:]] == flat[order[:-1]]
    many = np.zeros(len(flat), dtype=bool)
    many[order[1:][again]] = many[order[:-1][again]] = True
    owner = np.frombuffer(b"".join(rows["owners"]), np.uint8)
    many &= owner != DEALT
    owners = [owner[a:b][many[a:b]].tobytes() for a, b in zip([0, *ends], ends)]
    found = rows[["block", "nodes", "least", "counted"]].assign(owners=owners)
    del keys, flat, order, again, many, owner
    give_back()
    return found[(found["owners"].str.len() > 0) | found["nodes"].notna()]


def _enough(key, rows: pd.DataFrame) -> pd.DataFrame:
    about = rows[rows["nodes"].notna()].iloc[0]
    nodes, least = (np.frombuffer(about[c], np.int64) for c in ("nodes", "least"))
    count = np.bincount(np.frombuffer(about["counted"] + b"".join(rows["owners"]), np.uint8), minlength=len(nodes))
    return pd.DataFrame({"node": nodes[count >= least]})


def _screened(sets: DataFrame, n_grams: int, name: str) -> DataFrame:
    """Nodes of ``sets(node, least, grams)`` that have ``least`` or more of their shingles, ``n_grams`` in all or
    fewer, in common with others (written)."""
    dealt = sets.select("node", "least", "grams").mapInArrow(
        _dealt(n_grams // PART_GRAMS + 1),
        "part long, block long, nodes binary, least binary, counted binary, owners binary, keys binary")
    met = dealt.groupBy("part").applyInPandas(_met, "block long, nodes binary, least binary, counted binary, owners binary")
    return stage(met.groupBy("block").applyInPandas(_enough, "node long"), name)


def _texts(docs: DataFrame, keys: DataFrame, repeats: bool, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``docs`` that the staged ``keys`` name (:func:`one_row_each`). Where these are too many to be
    broadcast, a Bloom filter of them keeps other texts out of the shuffle."""
    if keys.count() > rows:
        path, parts = bloom.filter_of(keys.select("tk1"), "alive-texts")

        def here(batches):
            for batch in batches:
                found = bloom.Filter.at(path, parts).passes(batch.column("tk1").to_numpy().view(np.uint64))
                yield batch.filter(pa.array(found))
        docs = docs.mapInArrow(here, docs.schema)
    return one_row_each(docs, keys, repeats, rows)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose whole sets link."""
    x = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga"))
    y = sets.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    small = stage(pairs.select("a", "b"), "pairs")
    hit = F.size(F.array_intersect("ga", "gb"))
    x = x.join(sized(stage(small.select("a").distinct(), "pair-ends")), "a", "left_semi")
    return (y.join(sized(small), "b").join(x, "a")
            .where(100 * hit >= 80 * (F.size("ga") + F.size("gb") - hit)).select("a", "b"))


def jaccard_components(documents: DataFrame, k: int = K, hot: int = HOT) -> DataFrame:
    """``doc_id, n_shingles, component_id, class_size`` for every row of ``documents``."""
    return component_rows(documents, k, hot).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_size")


def component_rows(documents: DataFrame, k: int = K, hot: int = HOT) -> DataFrame:
    """``doc_id, tk1, tk2, n, comp, component_id, class_size`` for every row of ``documents``: its key
    (:func:`text_key`), shingles, component (null without shingles; ids do not matter to it) and the
    smallest id in it."""
    docs = documents.select("doc_id", "text", *text_key())
    kind = documents.schema["doc_id"].dataType.simpleString()
    base = docs.mapInArrow(_prefix_batches(k), f"doc_id {kind}, tk1 long, tk2 int, n long, s1 long, s2 long, "
                                               "prefix array<long>")
    base = stage(base.withColumn("node", F.monotonically_increasing_id()), "sets")

    # one class per distinct set; rows other than its first are set aside
    full = base.where("n > 0")
    classes = stage(full.groupBy("s1", "s2", "n").agg(
        F.min("node").alias("node"), F.min("doc_id").alias("low"), F.count("*").alias("class_size")), "classes")
    many = classes.where("class_size > 1").select("s1", "s2", "n", F.col("node").alias("first"))
    spare = stage(full.select("s1", "s2", "n", "node").join(many, ["s1", "s2", "n"])
                  .where("node <> first").select("node"), "spare")
    single = full.select("node", "n", "prefix").join(sized(spare), "node", "left_anti")

    # first screen: classes with enough shingles of two classes or more, in their prefixes and then in their whole sets
    floor = F.greatest(F.lit(1), F.expr("(4 * n + 4) div 5 div 16"))
    n_grams = full.agg(F.sum(F.size("prefix").cast("long"))).first()[0] or 0
    alive = _screened(single.select("node", floor.alias("least"), F.col("prefix").alias("grams")), n_grams, "alive")
    repeats = has_repeats(base)

    def sets_of(nodes: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Keys and whole sets of nodes, found again by their text."""
        keys = stage(base.join(sized(nodes), "node").select("node", "n", "doc_id", "tk1", "tk2"), name)
        texts = _texts(docs, keys, repeats)
        return keys, texts.select("node", "text").mapInArrow(_set_batches(k), "node long, grams array<long>")

    keys, sets = sets_of(alive, "alive-keys")
    n_grams = keys.agg(F.sum("n")).first()[0] or 0
    least = F.expr("(4 * size(grams) + 4) div 5").alias("least")
    alive = _screened(sets.select("node", least, "grams"), n_grams, "alive-whole")
    sets = stage(sets_of(alive, "kept-keys")[1], "whole-sets")
    single = full.select("node", "n", "prefix").join(sized(alive), "node")
    posts = single.select("node", "n", F.explode("prefix").alias("gram"))
    seen = posts.groupBy("gram").agg(F.count("*").alias("df")).where("df >= 2")
    kept = stage(posts.join(seen, "gram").groupBy("node", "n")
                 .agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("grams"))
                 .where(F.size("grams") >= floor), "screened")

    # second screen: rare shingles first, each document at its cheapest level
    spent = lambda l: F.aggregate(F.slice("grams", 1, F.size("grams") - floor + l),
                                  F.lit(0.0), lambda s, g: s + g["df"] - 1)
    costs = F.array(*[F.when(F.lit(l) <= floor, F.struct(
        (spent(F.lit(l).cast("int")) * (1 + VERIFY * F.col("n") / l)).alias("cost"), F.lit(l).alias("level")))
        for l in LEVELS])
    posts = stage(kept.withColumn("floor", floor)
                  .withColumn("level", F.array_min(F.filter(costs, lambda c: c.isNotNull()))["level"])
                  .select("node", "n", "level", F.explode(F.expr(
                      "slice(grams, 1, cast(size(grams) - floor + level as int))")).alias("g"))
                  .select("node", "n", "level", "g.gram"), "postings")

    # one pivot for each document, then whatever still lies in different components
    pivot = posts.groupBy("gram").agg(F.min("node").alias("p"))
    met = posts.join(pivot, "gram").where("node > p").groupBy("node", "p").agg(F.count("*").alias("c"))
    best = met.groupBy("node").agg(F.max(F.struct("c", "p")).alias("m"))
    links = stage(_verified(best.select(F.col("node").alias("a"), F.col("m.p").alias("b")), sets), "links")
    label = stage(posts.select("node").distinct().join(components(links), "node", "left")
                  .select("node", F.coalesce("comp", "node").alias("comp")), "labels")
    open_posts = posts.join(sized(label), "node")
    mixed = (open_posts.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"),
                                            F.count("*").alias("df")).where("lo < hi").select("gram", "df"))
    open_posts = stage(open_posts.join(mixed, "gram"), "open")
    links = stage(links.unionByName(_rare_pairs(open_posts.where(F.col("df") <= hot), sets))
                  .unionByName(_hot_links(open_posts.where(F.col("df") > hot), sets)), "links")
    comps = components(links)

    # every row: class, component, smallest id
    tagged = classes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    lows = tagged.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = tagged.join(lows, "comp").select("s1", "s2", "n", "comp", "component_id", "class_size")
    rows = base.select("doc_id", "tk1", "tk2", "n", "s1", "s2")
    out = rows.where("n > 0").join(named, ["s1", "s2", "n"]).select(
        "doc_id", "tk1", "tk2", "n", "comp", "component_id", "class_size")
    blank = rows.where("n = 0").select("doc_id", "tk1", "tk2", "n", F.lit(None).cast("long").alias("comp"),
                                       F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("class_size"))
    return out.unionByName(blank)


def _rare_pairs(posts: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of documents in different components that share enough shingles with short lists.

    Lists are bounded, so pairs grow with the postings. A pair that also shares a long list is
    found by :func:`_hot_links`; any other has all its matches here."""
    x = posts.select("gram", *[F.col(c).alias(f"{c}1") for c in ("node", "n", "level", "comp")])
    y = posts.select("gram", *[F.col(c).alias(f"{c}2") for c in ("node", "n", "level", "comp")])
    pairs = (x.join(y, "gram").where("comp1 < comp2 and 5 * n1 >= 4 * n2 and 5 * n2 >= 4 * n1")
             .groupBy("node1", "node2").agg(F.count("*").alias("c"), F.min(F.least("level1", "level2")).alias("l"))
             .where("c >= l"))
    return _verified(pairs.select(F.col("node1").alias("a"), F.col("node2").alias("b")), sets)


def _hot_links(posts: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links of documents that share shingles with long lists.

    Such documents are gathered into clusters by stars over the lists; a cluster is cut into
    blocks of documents, and each pair of blocks is one group that counts whole-set overlaps by
    matrix products and returns a spanning forest of its links, a row a document at most."""
    low = posts.groupBy("gram").agg(F.min("node").alias("b"))
    stars = posts.join(low, "gram").select(F.col("node").alias("a"), "b").where("a <> b").distinct()
    member = stage(components(stars), "clusters")
    size = member.groupBy("comp").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    cut = stage(member.join(sized(stage(size, "cluster-sizes")), "comp")
                .withColumn("at", F.pmod(F.xxhash64("node", F.lit(5)), "blocks").cast("int")), "cuts")
    cut = sets.join(sized(cut), "node").select(F.col("comp").alias("cluster"), "at", "blocks", "node", "grams")
    cut = stage(cut, "cluster-sets")
    left = cut.select("cluster", F.col("at").alias("i"), F.explode(F.expr("sequence(at, blocks - 1)")).alias("j"),
                      "node", "grams")
    right = cut.where("at > 0").select(F.col("cluster").alias("cluster2"), F.explode(F.expr("sequence(0, at - 1)")).alias("i2"),
                                       F.col("at").alias("j2"), F.col("node").alias("node2"), F.col("grams").alias("grams2"))
    return (left.groupBy("cluster", "i", "j").cogroup(right.groupBy("cluster2", "i2", "j2"))
            .applyInPandas(_forest, "a long, b long"))


def _forest(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    found = _block_links(key, left, right)
    give_back()
    return found


def _block_links(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Spanning forest of the links between two blocks (or inside one: no right side)."""
    parts = [left["grams"]] if right.empty else [left["grams"], right["grams2"]]
    nodes = np.concatenate([left["node"], *([] if right.empty else [right["node2"]])]).astype(np.int64)
    grams = [np.asarray(g, dtype=np.int64) for part in parts for g in part]
    n = np.array([len(g) for g in grams])
    owner = np.repeat(np.arange(len(grams)), n)
    flat = np.concatenate(grams) if grams else np.zeros(0, np.int64)
    _, gram, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[gram] > 1
    owner, gram = owner[shared], np.unique(gram[shared], return_inverse=True)[1]
    width = int(gram.max()) + 1 if len(gram) else 0
    order = np.argsort(gram, kind="stable")
    owner, gram = owner[order], gram[order]
    a = len(left)
    lo = (0, a) if right.empty else (a, len(grams))
    overlap = np.zeros((a, lo[1] - lo[0]), dtype=np.float32)
    for start in range(0, width, COLUMNS):
        x, y = np.searchsorted(gram, [start, start + COLUMNS])
        dense = np.zeros((len(grams), min(COLUMNS, width - start)), dtype=np.float32)
        dense[owner[x:y], gram[x:y] - start] = 1
        overlap += dense[:a] @ dense[lo[0]:lo[1]].T
    link = 100 * overlap >= 80 * (n[:a, None] + n[None, lo[0]:lo[1]] - overlap)
    label = np.arange(len(grams))
    while True:
        before = label.copy()
        low = np.where(link, label[None, lo[0]:lo[1]], len(grams)).min(axis=1, initial=len(grams))
        label[:a] = np.minimum(label[:a], low)
        low = np.where(link, label[:a, None], len(grams)).min(axis=0, initial=len(grams))
        label[lo[0]:lo[1]] = np.minimum(label[lo[0]:lo[1]], low)
        if (label == before).all():
            break
    moved = label != np.arange(len(grams))
    return pd.DataFrame({"a": nodes[moved], "b": nodes[label[moved]]})


def keep_one(documents: DataFrame, k: int = K) -> DataFrame:
    """``documents`` without all but one row of each component: of its smallest id (rows without
    an id come last, then the smallest text key decides), and one of rows that are equal in id and
    text. Rows of one id in different components, and rows without shingles, do not touch each other."""
    rows = stage(component_rows(documents, k).where("n > 0").select("doc_id", "tk1", "tk2", "comp"), "members")
    first = stage(rows.groupBy("comp").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk1", "tk2")).alias("first"),
        F.count("*").alias("size")).where("size > 1").select("comp", "first"), "firsts")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & F.expr("tk1 = first.tk1 and tk2 = first.tk2")
    # equal id and text means equal sets: all rows of a key are in one component
    keys = stage(rows.join(sized(first), "comp").withColumn("stays", stays)
                 .groupBy(F.col("doc_id").alias("_id"), F.col("tk1").alias("_k1"), F.col("tk2").alias("_k2"), "stays")
                 .agg(F.count("*").alias("rows")).where("not stays or rows > 1"), "keys")
    losers, twice = keys.where("not stays").drop("stays", "rows"), keys.where("stays").drop("stays", "rows")
    at = [c.alias(n) for c, n in zip(text_key(), ("_t1", "_t2"))]
    keyed = documents.select("*", *at)
    here = F.col("doc_id").eqNullSafe(F.col("_id")) & F.expr("_t1 = _k1 and _t2 = _k2")
    kept = keyed.join(sized(losers), here, "left_anti")
    if twice.isEmpty():
        return kept.drop("_t1", "_t2")
    once = kept.join(sized(twice), here, "left_semi").dropDuplicates(["doc_id", "_t1", "_t2"])
    return kept.join(sized(twice), here, "left_anti").unionByName(once).drop("_t1", "_t2")
