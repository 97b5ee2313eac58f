"""Near-duplicates by SimHash, with an exact check of what it finds and an exact way to what it cannot find.

Equal shingle sets are one class. Each class has a 64-bit SimHash fingerprint of its set; fingerprints are split into blocks,
joined on blocks, and linked where their Hamming distance is small (`simhash.close_pairs`). What is linked that way is a
component, and inside it the classes' sets are compared: those with a Jaccard similarity of the threshold or more are near-duplicates.

Two sets at a similarity of 0.8 differ in some 15 % of their bits, so no guaranteed split of the bits leaves a block
that selects anything: the fingerprints find the close pairs, not all. The rest is found on the sets themselves. Sets of
n shingles and similarity s or more have at least s n in common, so of any n - ceil(s n) + 1 shingles of one
the other has at least one (pigeonhole). Those shingles, the rarest first in one order for all sets, are the
blocks; sets that share one are gathered into clusters and compared, but for pairs that SimHash has put together already.
So no true pair is lost and none is accepted wrongly; nothing depends on the number of documents.

A third of all shingles (by hash) are counted first, combined in the map tasks: a class with as many shingles of its own
there as it has blocks can have no partner. That settles all but classes whose text is mostly shared, and only the
sets of those are compared, in either step.

A cluster's sets are compared in chunks of bounded size, each with a few pivots that all chunks share, so the rows
are linear in the cluster; a family of near copies becomes one component in this step. Only what is not yet in
its cluster's largest component is then compared with the other chunks. Comparisons skip sets that are already in one component.

Defined results: null and wordless texts are one class; a text with fewer words than a shingle is its
whole sequence; documents with a null id are never linked; repeated ids are one document (of several texts under
one id, one at least is compared with others); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import Scratch, claim_worker, csr_take, scratch_dir, slices, written
from larkspur.llm.components import connected_components
from larkspur.llm.simhash import close_pairs, majority, shingle_hashes

PIVOTS = 16
#: Classes (an id and a digest each, some 64 bytes in a hash table) are sent to all executors up to this number; beyond it texts are shuffled to them.
MOST_BROADCAST = 500_000


def blocks_of(n: int, similarity: float) -> int:
    """How many of its n shingles a set needs, so that every set of that similarity has one of them."""
    return n - math.ceil(similarity * n - 1e-9) + 1


def _sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    return [np.unique(np.array(shingle_hashes(t, width, 42), np.uint64)) for t in texts]


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))


def _marked(df: DataFrame, similarity: float, width: int, id_col: str, text_col: str, batch_bytes: int) -> DataFrame:
    """(id, size, need, digest, fp): size of each document's set, how many blocks it needs, what tells it from other sets, and its SimHash fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("simhash")
        for b in slices(batches, "_text", batch_bytes):
            sets = _sets(b.column("_text").to_pylist(), width)
            sizes = [len(s) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(sizes, pa.int64()), pa.array([blocks_of(n, similarity) for n in sizes], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()), pa.array(majority(np.concatenate(sets), np.array(sizes, np.int64)).view(np.int64))], names=["id", "size", "need", "digest", "fp"])

    return _texts(df, id_col, text_col).mapInArrow(run, "id long, size long, need long, digest binary, fp long")


def _of_classes(df: DataFrame, classes: DataFrame, width: int, id_col: str, text_col: str, batch_bytes: int, schema: str, rows) -> DataFrame:
    """`rows(ids, sets)` over the sets of the classes (id, digest); other texts under the same ids are left out."""
    wanted = classes.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"))
    wanted = wanted.hint("broadcast" if wanted.count() <= MOST_BROADCAST else "merge")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("simhash")
        for b in slices(batches, "_text", batch_bytes):
            sets = _sets(b.column("_text").to_pylist(), width)
            own = [i for i, (s, d) in enumerate(zip(sets, b.column("_digest").to_pylist())) if _digest(s) == d]
            if own:
                yield rows(b.column("_id").to_numpy()[own], [sets[i] for i in own])

    return _texts(df, id_col, text_col).join(wanted, "_id").mapInArrow(run, schema)


def _sampled(df: DataFrame, copies: DataFrame, width: int, id_col: str, text_col: str, batch_bytes: int) -> DataFrame:
    """(key, id) of the shingles with a hash in the lower third of each document but `copies` (id), known by 48 bits: keys that meet by chance send a document on, no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("simhash")
        for b in slices(batches, "_text", batch_bytes):
            sets = [s[: np.searchsorted(s, np.uint64((1 << 64) // 3))] for s in _sets(b.column("_text").to_pylist(), width)]
            keys = np.concatenate(sets) & np.uint64((1 << 48) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.repeat(b.column("_id").to_numpy(), [len(s) for s in sets]))], names=["key", "id"])

    return _texts(df, id_col, text_col).join(copies.select(F.col("id").alias("_id")), "_id", "left_anti").mapInArrow(run, "key long, id long")


def _whole(ids: np.ndarray, sets: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))], names=["id", "shingles"])


def merges(ids: np.ndarray, labels: np.ndarray, probes: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join what the pairs of sets at or over the similarity join, of a probe each and whose labels differ.

    `labels` are components known so far. A probe is compared with sets of other components only.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    starts = np.cumsum(sizes) - sizes
    known, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(known), np.int64)
    labels, links = labels.copy(), []
    for i in probes.tolist():
        tried = np.flatnonzero((labels != labels[i]) & (np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i]) - 1e-9))
        if not len(tried):
            continue
        own = flat[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        shared = np.add.reduceat(mark[flat[csr_take(starts[tried], sizes[tried])]], np.cumsum(sizes[tried]) - sizes[tried])
        mark[own] = 0
        found = tried[shared / (sizes[i] + sizes[tried] - shared) >= similarity]
        met, first = np.unique(labels[found], return_index=True)
        links += [(int(ids[i]), int(ids[j])) for j in found[first]]
        labels[np.isin(labels, met)] = labels[i]
    return links


def _linked(dealt: DataFrame, sets: DataFrame, keys: list[str], similarity: float) -> DataFrame:
    """Links within each group of `dealt` (keys, id, label, probe)."""

    def compare(group: pa.Table) -> pa.Table:
        order = np.lexsort((~group.column("probe").to_numpy(), group.column("id").to_numpy()))
        ids, first = np.unique(group.column("id").to_numpy()[order], return_index=True)  # repeated rows; a probe stays one
        group = group.take(pa.array(order[first]))
        shingles = group.column("shingles").combine_chunks()
        flat, at = shingles.values.to_numpy().view(np.uint64), shingles.offsets.to_numpy()
        links = merges(ids, group.column("label").to_numpy(), np.flatnonzero(group.column("probe").to_numpy()), [flat[i:j] for i, j in zip(at[:-1], at[1:])], similarity)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    return dealt.join(sets, "id").select("id", "label", "probe", "shingles", *keys).groupBy(*keys).applyInArrow(compare, "a long, b long")


def _compared(dealt: DataFrame, sets: DataFrame, keys: list[str], similarity: float) -> DataFrame:
    """Links that shared shingles lead to."""
    return _linked(dealt, sets, keys, similarity)


def hamming_clusters(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component): classes (id, fp) with others of the same fingerprint or within its Hamming distance, directly or through others."""
    fps = scratch.written(classes.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "similar-fingerprints")
    lowest = connected_components(close_pairs(fps.select("fp")).withColumnsRenamed({"fp_a": "a", "fp_b": "b"}))
    together = fps.join(lowest, fps["fp"] == lowest["node"], "left").where("n > 1 or component is not null").select("fp", F.coalesce("component", "fp").alias("component"))
    return classes.join(together, "fp").select("id", "component")


def _clusters(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component): classes (id, size, need, shingles) that share blocks, directly or through others."""
    rows = sets.select("id", F.explode("shingles").alias("s"))
    shared = scratch.written(rows.groupBy("s").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("s", "n"), "similar-shared")
    by_rarity = Window.partitionBy("id").orderBy("n", "s")
    # Both sides grow with the corpus, so neither is broadcast at any size.
    ranked = rows.join(shared.hint("merge"), "s").withColumn("rank", F.dense_rank().over(by_rarity))
    ranked = ranked.withColumn("n_shared", F.max("rank").over(Window.partitionBy("id"))).join(sets.select("id", "size", "need").distinct(), "id")
    # Shingles of the class alone come first in the order, and link nothing.
    cells = scratch.written(ranked.where(F.col("rank") <= F.col("need") - (F.col("size") - F.col("n_shared"))).select("s", "id"), "similar-cells")
    hubs = cells.groupBy("s").agg(F.min("id").alias("hub"), F.max("id").alias("high")).where("hub < high").select("s", "hub")
    return connected_components(cells.join(hubs, "s").where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b"))).withColumnRenamed("node", "id")


def _in_chunks(clusters: DataFrame, sets: DataFrame, scratch: Scratch, enough) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members of the clusters with their sizes, clusters of several chunks, members and pivots dealt to chunks)."""
    members = scratch.written(clusters.join(sets.groupBy("id").agg(F.first("size").alias("size")), "id"), "similar-members")
    pivots = F.array_distinct(F.array(*[F.min(F.struct(F.xxhash64("id", F.lit(k)), "id"))["id"] for k in range(PIVOTS)]))
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"), enough(F.count(F.lit(1)), F.sum("size")).alias("chunks"), pivots.alias("pivots"))
    clustered = scratch.written(sizes.where("n > 1").drop("n"), "similar-sizes")
    own = members.join(clustered, "component").select("component", "id", _chunk("id", F.col("chunks")).alias("chunk"))
    large = clustered.where("chunks > 1")
    everywhere = large.select("component", "pivots", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")).select("component", F.explode("pivots").alias("id"), "chunk")
    return members, large, own.unionByName(everywhere).withColumn("probe", F.lit(True))


def _chunk(column: str, n):
    return F.pmod(F.xxhash64(column), n).cast("int")


def _enough(most: int, most_shingles: int):
    return lambda n, size: F.ceil(F.greatest(n / most, size / most_shingles)).cast("int")


def checked_links(sets: DataFrame, clusters: DataFrame, similarity: float, scratch: Scratch, most: int = 1024, most_shingles: int = 1 << 20) -> DataFrame:
    """Links (a, b) between `sets` (id, size, shingles) at or over `similarity` in one chunk of a cluster (id, component); pivots are in all its chunks."""
    dealt = _in_chunks(clusters, sets, scratch, _enough(most, most_shingles))[2].withColumn("label", F.col("id"))
    return scratch.written(_linked(scratch.written(dealt, "similar-near"), sets, ["component", "chunk"], similarity), "similar-checked")


def exact_links(sets: DataFrame, clusters: DataFrame, known: DataFrame, similarity: float, scratch: Scratch, most: int = 1024, most_shingles: int = 1 << 20) -> DataFrame:
    """Links (a, b) that with those `known` join all that pairs of `sets` (id, size, shingles) at or over `similarity` inside a cluster (id, component) join.

    A chunk has about `most` sets or `most_shingles` shingles.
    """
    enough, chunk = _enough(most, most_shingles), _chunk
    labelled = lambda df, links: df.join(connected_components(links).withColumnsRenamed({"node": "id", "component": "label"}), "id", "left").withColumn("label", F.coalesce("label", "id"))
    members, large, dealt = _in_chunks(clusters, sets, scratch, enough)
    links = known.unionByName(scratch.written(_compared(scratch.written(labelled(dealt, known), "similar-dealt"), sets, ["component", "chunk"], similarity), "similar-links"))
    if large.isEmpty():
        return links

    # What is not in its cluster's largest component meets the other chunks.
    labels = labelled(members.join(large.select("component", "chunks"), "component"), links)
    labels = scratch.written(labels, "similar-labels")
    parts = labels.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    split = parts.groupBy("component").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.sum("n").alias("n"), F.max("n").alias("n_main"), F.sum("size").alias("size"), F.max(F.struct("n", "label", "size"))["size"].alias("size_main")).where("n > n_main")
    split = scratch.written(split.select("component", "main", enough(F.col("n") - F.col("n_main"), F.col("size") - F.col("size_main")).alias("blocks")), "similar-split")
    if split.isEmpty():
        return links
    apart = labels.join(split, "component")
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = apart.select("component", "id", "label", F.lit(False).alias("probe"), chunk("id", F.col("chunks")).alias("chunk"), to("blocks").alias("block"))
    probes = apart.where("label <> main").select("component", "id", "label", F.lit(True).alias("probe"), to("chunks").alias("chunk"), chunk("id", F.col("blocks")).alias("block"))
    return links.unionByName(_compared(scratch.written(base.unionByName(probes), "similar-apart"), sets, ["component", "chunk", "block"], similarity))


def groups(df: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 20, most: int = 1024) -> DataFrame:
    """(id, component): the smallest id of each document's group of texts with shingle sets of that similarity or more."""
    scratch_dir(df.sparkSession)
    scratch = Scratch(df.sparkSession)
    marked = written(_marked(df, similarity, width, id_col, text_col, batch_bytes), "similar-marked")
    classes = written(marked.groupBy("digest").agg(F.min(F.struct("id", "size", "need", "fp")).alias("c")).select("c.*", "digest"), "similar-classes")
    members = marked.join(classes.select("digest", F.col("id").alias("first")), "digest").select("id", "first")
    single = classes.where("size > 0").dropDuplicates(["id"])
    # Written, so that its size is known when the texts are joined with it.
    copies = scratch.written(members.where("id <> first").select("id").distinct().join(classes.select("id"), "id", "left_anti"), "similar-copies")
    keys = _sampled(df, copies, width, id_col, text_col, batch_bytes)
    alone = keys.groupBy("key").agg(F.min("id").alias("id"), F.max("id").alias("high")).where("id = high").groupBy("id").agg(F.count(F.lit(1)).alias("alone"))
    # The shingles of several texts under one id say nothing about each of them.
    alone = alone.join(marked.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "id", "left_anti")
    still = scratch.written(single.join(alone, "id", "left").where(F.coalesce("alone", F.lit(0)) < F.col("need")).select("id", "size", "need", "digest"), "similar-open")
    sets = scratch.written(_of_classes(df, still, width, id_col, text_col, batch_bytes, "id long, shingles array<long>", _whole).join(still.select("id", "size", "need"), "id"), "similar-sets")
    near = hamming_clusters(single.select("id", "fp"), scratch).join(still.select("id"), "id", "left_semi")
    near = checked_links(sets, near, similarity, scratch, most)
    # An id that comes with several texts links their classes.
    links = members.where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b")).unionByName(exact_links(sets, _clusters(sets, scratch), near, similarity, scratch, most))
    lowest = connected_components(links)
    scratch.clear()  # components are checkpointed
    return members.select("id").distinct().join(lowest, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", **parameters) -> DataFrame:
    """The rows of `df` without all but the smallest id of each group; rows with a null id stay, repeated ids stay once."""
    found = groups(df, id_col=id_col, **parameters)
    # Written, so that its size is known when the texts are joined with it: they are shuffled only if it is large.
    gone = written(found.where("id <> component").select(F.col("id").alias(id_col)), "similar-gone")
    kept = df.join(gone, id_col, "left_anti")
    again = df.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col).checkpoint()
    if again.isEmpty():
        return kept
    single = kept.join(again, id_col, "left_anti")
    return single.unionByName(kept.join(again, id_col, "left_semi").dropDuplicates([id_col]).select(*single.columns))
