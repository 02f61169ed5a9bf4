"""Exact Jaccard join of documents on word shingles, with adaptive multi-match prefixes.

Two sets of Jaccard similarity of at least t share at least l of the first
n - ceil(t n) + l elements of each, in any common order of elements, for every l.

1. Equal sets are one node from the start, whatever the number of copies.
2. Screening, in hash order, where no counting of the corpus is needed: with l growing
   with the size, a node stays only if so many of its prefix shingles occur in prefixes
   of other nodes.
3. The nodes left are ordered by frequency.  Each lengthens its prefix as long as the
   estimated cost of its candidates falls, and asks for as many shared shingles.
4. Groups of near copies are joined to pivots first: each node meets the one pivot with
   which it shares most prefix shingles, not all others; nodes with the fewest shingles
   of their own are the first pivots.  Candidates are then formed
   between different components only; two nodes of one component need no comparison.
5. Two nodes close to one pivot differ where exactly one of them differs from it.  Such
   pairs come from the differences, which are few and rare, not from the shingles that the
   whole group has.
6. Every link is decided on whole sets.  Nothing is capped or sampled.

Edge cases: null or empty texts and texts of white space have an empty set and are
linked with nothing; shorter texts have their whole sequence as one shingle; repeated
rows and ties share a class; rows with a null doc_id take part and are kept, only their
id is never a class id; doc_ids are not negative; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Words, binary_list, drop, free, mix, ship, slices, store
from .components import components

#: Shared prefix shingles that are asked for in screening: one and this part of the overlap.
SCREEN = 20
#: Most shared shingles that a prefix may ask for.
LEVELS = 6
#: Cost of reading one posting, against one for each shingle compared in a verification.
POSTING = 2.0


def shingle_sets(docs: DataFrame, words: int, num: int, den: int, whole: bool) -> DataFrame:
    """doc_id, n, hi, lo (the set and its 128-bit signature), need, and the prefix in hash order, or the whole set."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, offsets = Words(batch.column("text")).shingles(words)
            rows = len(offsets) - 1
            n, hi, lo, need = (np.zeros(rows, np.int64) for _ in range(4))
            kept = []
            for i in np.flatnonzero(np.diff(offsets)):
                own = np.unique(hashes[offsets[i]:offsets[i + 1]])
                n[i] = len(own)
                hi[i] = own.sum(dtype=np.uint64).astype(np.int64)
                lo[i] = mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)
                least = -(-num * len(own) // den)
                need[i] = 1 + -(-num * least // den) // SCREEN
                kept.append(own if whole else own[:len(own) - least + 1 + least // SCREEN])
            sizes = np.zeros(rows, np.int64)
            sizes[n > 0] = [len(k) for k in kept]
            values = np.concatenate(kept) if kept else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *map(pa.array, (n, hi, lo, need)),
                                              binary_list(values, np.concatenate([[0], np.cumsum(sizes)]))], ["doc_id", "text_key", "n", "hi", "lo", "need", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(make, "doc_id long, text_key long, n long, hi long, lo long, need long, shingles array<long>")


def _screened(nodes: DataFrame) -> DataFrame:
    """Nodes that may be similar to another one (2)."""
    entries = nodes.select("node", F.explode("shingles").alias("s"))
    shared = entries.groupBy("s").agg(F.count("*").alias("df")).where("df > 1").select("s")
    hits = entries.join(shared, "s").groupBy("node").agg(F.count("*").alias("hits"))
    return nodes.select("node", "n", "hi", "lo", "need").join(hits, "node").where("hits >= need").select("node", "n", "hi", "lo")


def _entries(whole: DataFrame, num: int, den: int) -> DataFrame:
    """Prefix entries in order of frequency: s, node, n, level (the least l whose prefix holds it), the node's chosen l (3) and ``most``.

    ``most`` is the number of its shingles that any other node has: no overlap is larger.
    """
    entries = whole.select("node", "n", F.explode("shingles").alias("s"))
    df = entries.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    shared = entries.join(df, "s").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("order"))  # a part of one document

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = batch.column("order")
            bounds = order.offsets.to_numpy()
            flat = order.values
            dfs, keys = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("df", "s"))
            node, n = batch.column("node").to_numpy(), batch.column("n").to_numpy()
            rows = []
            for i in range(len(node)):
                a, b, size = bounds[i], bounds[i + 1], int(n[i])
                spare = size - -(-num * size // den)  # prefix of l: spare + l elements, those of one node first
                place = size - (b - a) + np.arange(b - a)
                level = np.maximum(1, place - spare + 1)
                most = min(LEVELS, size - spare)
                keep = level <= LEVELS
                level, work = level[keep], (dfs[a:b] - 1)[keep]
                costs = []
                for l in range(1, most + 1):
                    read = float(work[level <= l].sum())
                    costs.append(read * POSTING + (read / l * size if (level <= l).sum() >= l else 0.0))
                rows.append((np.full(len(level), node[i]), np.full(len(level), size), keys[a:b][keep], level, np.full(len(level), 1 + int(np.argmin(costs))),
                             np.full(len(level), b - a)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*rows)], ["node", "n", "s", "level", "l", "most"])

    return shared.mapInArrow(choose, "node long, n long, s long, level long, l long, most long")


def _verify(pairs: DataFrame, whole: DataFrame, num: int, den: int) -> DataFrame:
    """The links (a, b) among candidate pairs (a, b), decided on whole sets."""
    left = whole.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = whole.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = pairs.hint("merge").join(left, "a").join(right.hint("merge"), "b").withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return both.where(den * F.col("i") >= num * (F.col("na") + F.col("nb") - F.col("i"))).select("a", "b")


def _labelled(entries: DataFrame, links: DataFrame) -> DataFrame:
    return entries.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))


def _may_link(a: str, b: str, num: int, den: int) -> Column:
    """Whether the sizes of two nodes, and the shingles that either shares with anyone, let them be similar."""
    overlap = F.least(f"most{a}", f"most{b}")
    return den * overlap >= num * (F.col(f"n{a}") + F.col(f"n{b}") - overlap)


def _to_pivots(entries: DataFrame, order: Column, num: int, den: int) -> DataFrame:
    """For each node the pivot (the first in ``order`` of those with a shingle) of another component with which it shares most prefix shingles (4)."""
    entries = entries.where("level = 1")
    pivot = entries.groupBy("s").agg(F.min(F.struct(order.alias("order"), "node", "n", "most", "component")).alias("p"), F.count("*").alias("df"))
    pivot = pivot.where("df > 1").select("s", F.col("p.node").alias("pivot"), F.col("p.n").alias("n_p"), F.col("p.most").alias("most_p"), F.col("p.component").alias("other"))
    met = entries.join(pivot, "s").where((F.col("other") != F.col("component")) & _may_link("", "_p", num, den))
    counted = met.groupBy("node", "pivot").agg(F.count("*").alias("c"))
    best = counted.groupBy("node").agg(F.max(F.struct("c", "pivot")).alias("best"))
    return best.select(F.col("node").alias("a"), F.col("best.pivot").alias("b"))


def _differences(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """node, pivot, n, n_p, and in what shingles the node differs from its pivot, of the nodes close to it."""
    left = whole.select(F.col("node").alias("a"), "n", F.col("shingles").alias("sa"))
    right = whole.select(F.col("node").alias("b"), F.col("n").alias("n_p"), F.col("shingles").alias("sb"))
    both = pairs.hint("merge").join(left, "a").join(right.hint("merge"), "b")
    diff = F.concat(F.array_except("sa", "sb"), F.array_except("sb", "sa"))
    return both.select(F.col("a").alias("node"), F.col("b").alias("pivot"), "n", "n_p", diff.alias("diff")).where("2 * size(diff) <= n + n_p")


def _near_pivots(near: DataFrame, links: DataFrame, num: int, den: int) -> DataFrame:
    """Candidate pairs (a, b) of nodes close to one pivot, from their differences (5).

    With D the differences of two nodes to the pivot, the nodes differ in D_a ^ D_b, so to
    be similar they share at least (|D_a| + |D_b| - r (n_a + n_b)) / 2 differences, where
    r = (den - num) / (den + num).  If that asks for none, both are linked to the pivot.
    """
    r = (den - num) / (den + num)
    names = components(links)
    near = near.withColumn("size", F.size("diff")).join(names, "node", "left").join(names.select(F.col("node").alias("pivot"), F.col("component").alias("home")), "pivot", "left")
    near = near.withColumn("component", F.coalesce("component", "node")).withColumn("home", F.coalesce("home", "pivot"))
    least = near.groupBy("pivot").agg(F.min("size").alias("least"))
    entries = near.select("pivot", "node", F.explode("diff").alias("s"))
    counts = entries.groupBy("pivot", "s").agg(F.count("*").alias("c")).where("c > 1")
    order = entries.join(counts, ["pivot", "s"]).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("order"))  # a part of two documents
    asked = F.greatest(F.lit(1), F.ceil((F.col("size") + (1 - r) * F.col("least") - r * (F.col("n") + F.col("n_p"))) / 2 - 1e-6).cast("int"))
    kept = near.drop("diff").join(least, "pivot").join(order, "node").select(
        "pivot", "node", "n", "size", "component", "home", F.posexplode(F.slice("order", F.lit(1), F.greatest(F.lit(0), F.size("order") - asked + 1))).alias("i", "o"), F.size("order").alias("many"))
    kept = kept.select("pivot", F.col("o.s").alias("s"), "node", "n", "size", "component", "home", (F.col("many") - F.col("i")).alias("after"))
    probe = kept.where("component <> home").select("pivot", "s", *[F.col(c).alias(f"{c}_a") for c in ("node", "n", "size", "component", "after")])
    index = kept.select("pivot", "s", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "size", "component", "after")])
    needed = (F.col("size_a") + F.col("size_b") - r * (F.col("n_a") + F.col("n_b"))) / 2 - 1e-6
    met = probe.join(index, ["pivot", "s"]).where((F.col("component_a") != F.col("component_b")) & (F.least("after_a", "after_b") >= needed))
    return met.select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b")).distinct()


def _candidates(entries: DataFrame, near: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of different components that share as many prefix shingles as the larger node asks for.

    Nodes close to one pivot are left to :func:`_near_pivots`.
    """
    entries = entries.join(near.select("node", "pivot"), "node", "left")
    probe = entries.where("level <= l").select("s", F.col("node").alias("a"), F.col("n").alias("na"), F.col("most").alias("mosta"), "l", F.col("component").alias("ca"), F.col("pivot").alias("pa"))
    index = entries.select("s", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("most").alias("mostb"), "level", F.col("component").alias("cb"), F.col("pivot").alias("pb"))
    met = probe.join(index, "s").where("level <= l and ca <> cb and (nb < na or nb = na and b < a) and not (pa <=> pb and pa is not null)").where(_may_link("a", "b", num, den))
    return met.groupBy("a", "b", "l").agg(F.count("*").alias("c")).where("c >= l").select("a", "b")


def similar_classes(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id: documents linked by ``den * intersection >= num * union`` share a component."""
    ship(docs.sparkSession)
    signed = store(shingle_sets(docs, words, num, den, whole=False), "signed")
    node = F.coalesce("doc", F.col("hi").bitwiseOR(F.lit(-1 << 63)))
    nodes = store(signed.where("n > 0").groupBy("n", "hi", "lo").agg(F.min("doc_id").alias("doc"), F.first("need").alias("need"), F.first("shingles").alias("shingles"))
                  .select(node.alias("node"), "n", "hi", "lo", "need", "shingles"), "nodes")
    ids = store(signed.select("doc_id", "text_key", "n", "hi", "lo"), "ids")
    drop(signed)
    kept = store(_screened(nodes), "screened")
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    wanted = texts.join(kept.select(F.col("node").alias("doc_id")).hint("merge"), "doc_id", "left_semi").unionByName(texts.where("doc_id is null"))
    sets = shingle_sets(wanted, words, num, den, whole=True).select("n", "hi", "lo", "shingles")
    whole = store(sets.join(kept, ["n", "hi", "lo"]).dropDuplicates(["node"]).select("node", "n", "shingles"), "sets")
    entries = store(_entries(whole, num, den), "entries")

    links = entries.sparkSession.createDataFrame([], "a long, b long")
    # The original of a group of copies has no shingle of its own, so it is the first pivot.
    pairs = store(_to_pivots(_labelled(entries, links), F.struct(F.col("n") - F.col("most"), F.xxhash64("node")), num, den), "pairs")
    near = store(_differences(pairs, whole), "differences")
    links = store(_verify(pairs, whole, num, den), "found")
    pairs = _to_pivots(_labelled(entries, links), F.struct(F.xxhash64("node", F.lit(1))), num, den)
    links = store(links.unionByName(_verify(pairs, whole, num, den)), "found")
    pairs = _near_pivots(near, links, num, den).unionByName(_candidates(_labelled(entries, links), near, num, den))
    links = store(links.unionByName(_verify(store(pairs, "pairs"), whole, num, den)), "found")
    for used in (whole, entries, kept, near):
        drop(used)

    found = components(links)
    named = found.groupBy("component").agg(F.min(F.when(F.col("node") >= 0, F.col("node"))).alias("component_id"))
    of_node = nodes.select("node", "n", "hi", "lo").join(found.join(named, "component"), "node", "left").select(
        "n", "hi", "lo", F.coalesce("component_id", F.when(F.col("node") >= 0, F.col("node"))).alias("component_id"))
    out = ids.join(of_node, ["n", "hi", "lo"], "left")
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, all columns, without near copies: of each component the text with the least doc_id stays, in one row.

    Rows without words stay.  Components of rows that all lack a doc_id keep one text each.
    """
    classes = similar_classes(docs, words, num, den).where("n_shingles > 0")
    group = F.coalesce("component_id", "text_key")
    kept = classes.groupBy(group.alias("g")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("k"))
    key, named, own = free(docs, "_key"), free(docs, "_id"), free(docs, "_text_key")
    kept = store(kept.select(F.col("k.text_key").alias(key), F.col("k.doc_id").alias(named)), "kept")
    keyed = docs.withColumn(own, F.xxhash64("text"))
    stay = keyed.join(kept, keyed[own] == kept[key]).where(F.col(named).eqNullSafe(F.col("doc_id"))).dropDuplicates([own]).select(*docs.columns)
    wordless = F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return stay.unionByName(docs.where(wordless))
