"""SimHash near-duplicates: pigeonhole blocks find candidate pairs, the Hamming distance decides.

A fingerprint's bits are split into blocks. Two fingerprints that differ in at most DISTANCE bits
differ in at most that many blocks, so they agree on some choice of `blocks - DISTANCE` whole
blocks; each choice with the bits in it is a key, and fingerprints are joined on keys.
Equal fingerprints are one class before any join, so copies are never paired.

A key that many different fingerprints share is not paired out: inside it only the bits outside
the key can differ, so each of its fingerprints lists its neighbours at half the distance there.
Two fingerprints within the distance meet in a common neighbour, and everything that meets in one
is within the distance, so a star per neighbour keeps every component in linear space.

Defined results: a null or wordless text has fingerprint zero and links like any other; documents
with a null id get a fingerprint and no component; repeated rows each give a row; an empty table
gives no rows; extra input columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import claim_worker, slices
from larkspur.llm.components import connected_components

_LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
#: bytes.split() without arguments splits on exactly the white space of the word definition.
BITS = 64
#: Bits in which linked fingerprints differ at most. It is fixed: the way through common neighbours is exact for 2.
DISTANCE = 2


def shingle_hashes(text: str | None, width: int, seed: int) -> list[int]:
    """XXH64 of each run of `width` words (all words, if fewer), repeats included; lower-cased A-Z."""
    words = ("" if text is None else text).encode().translate(_LOWER).split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [h(joined, seed)]
    return [h(joined[a : b - 1], seed) for a, b in zip([0, *ends], ends[width - 1 :])]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprint of each run of hashes: bits that are set in over half of the run; empty runs give zero."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    ends = np.cumsum(counts[full])
    starts = ends - counts[full]
    # Up to 255 hashes are added in byte lanes, eight at a time in one 64-bit word.
    lanes = np.unpackbits(hashes.astype(">u8").view(np.uint8)).view(np.uint64).reshape(-1, 8)
    pieces = -(-counts[full] // 255)
    owner = np.repeat(np.arange(len(full)), pieces)
    first = np.cumsum(pieces) - pieces
    cut = starts[owner] + 255 * (np.arange(len(owner)) - first[owner])
    lanes = np.add.reduceat(lanes, cut, axis=0)
    votes = np.add.reduceat(np.ascontiguousarray(lanes).view(np.uint8).reshape(-1, BITS).astype(np.int64), first, axis=0)
    bits = (2 * votes > counts[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprints(df: DataFrame, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 2 << 20) -> DataFrame:
    """(id, fp long): the 64-bit fingerprint of every row."""
    names = [id_col, "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("simhash")
        for b in slices(batches, "_text", batch_bytes):
            hashes: list[int] = []
            counts = np.zeros(b.num_rows, np.int64)
            for i, t in enumerate(b.column("_text").to_pylist()):
                own = shingle_hashes(t, width, seed)
                counts[i] = len(own)
                hashes += own
            fp = majority(np.array(hashes, np.uint64), counts)
            yield pa.RecordBatch.from_arrays([b.column("_id").cast(pa.int64()), pa.array(fp.view(np.int64))], names=names)

    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"{id_col} long, fp long")


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def block_masks(blocks: int, distance: int = DISTANCE) -> list[int]:
    """Masks of every choice of `blocks - distance` of the blocks that the bits are split into."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    own = [sum(1 << b for b in range(i, j)) for i, j in zip(edges, edges[1:])]
    return [sum(choice) for choice in itertools.combinations(own, blocks - distance)]


def close_pairs(fps: DataFrame, blocks: int = 5, pair_limit: int = 32) -> DataFrame:
    """Links (fp_a, fp_b) between different fingerprints within DISTANCE bits that join all that chains of such pairs join.

    `fps` has distinct values of `fp`. Keys of up to `pair_limit` fingerprints are joined pair by
    pair; larger ones go through common neighbours. A key of a third of all fingerprints is split by the
    adaptive skew join, and its neighbours' least fingerprints are combined in the map tasks.
    """
    masks = block_masks(blocks)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("choice", "key"))
    shared = keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Nearly all keys hold one fingerprint; what is left is written once and read by both ways.
    crowded = keyed.join(shared, ["choice", "key"]).checkpoint()
    few = crowded.where(F.col("n") <= pair_limit)
    left, right = few.select("choice", "key", F.col("fp").alias("fp_a")), few.select("choice", "key", F.col("fp").alias("fp_b"))
    near = F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= DISTANCE
    pairs = left.join(right, ["choice", "key"]).where("fp_a > fp_b").where(near).select("fp_a", "fp_b")
    free = [[_signed(1 << b) for b in range(BITS) if not m >> b & 1] for m in masks]
    flips = F.element_at(F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(x).cast("long") for x in own]) for own in _even(free)]), F.col("choice") + 1)
    many = crowded.where(F.col("n") > pair_limit).select("choice", "fp", F.explode(flips).alias("flip"))
    meeting = many.select("choice", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"))
    hubs = meeting.groupBy("choice", "middle").agg(F.min("fp").alias("fp_b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    stars = meeting.join(hubs, ["choice", "middle"]).select(F.col("fp").alias("fp_a"), "fp_b").where("fp_a > fp_b").where(near)
    return pairs.unionByName(stars).distinct()


def _even(rows: list[list[int]]) -> list[list[int]]:
    """Rows of equal length; repeats of a flip do no harm."""
    longest = max(map(len, rows))
    return [r + r[:1] * (longest - len(r)) for r in rows]


def near_duplicates(df: DataFrame, width: int = 3, seed: int = 42, blocks: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of every row: linked where fingerprints differ in DISTANCE bits or fewer."""
    marked = fingerprints(df, width, seed, id_col, text_col).checkpoint()
    classes = marked.where(F.col(id_col).isNotNull()).groupBy("fp").agg(F.min(id_col).alias("first")).checkpoint()
    links = close_pairs(classes.select("fp"), blocks)
    name = classes.select("fp", "first")
    links = links.join(name.withColumnsRenamed({"fp": "fp_a", "first": "a"}), "fp_a").join(name.withColumnsRenamed({"fp": "fp_b", "first": "b"}), "fp_b").select("a", "b")
    lowest = connected_components(links)
    of_class = classes.join(lowest, classes["first"] == lowest["node"], "left").select("fp", F.coalesce("component", "first").alias("component_id"))
    return marked.join(of_class, "fp", "left").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col(id_col).isNotNull(), F.col("component_id")).alias("component_id"))
