"""Language-model scoring with a weighted backoff automaton of n-grams (trigrams by default).

States are contexts: the root, and every run of up to n - 1 tokens that was followed by something in
training (the start of a text counts as a token in front of it). A state has an arc for each token
that followed it in training, and a failure arc to the state of the context without its first token.
With c the training counts, k the prior weight, v a context and v' its shorter one,

    root arc      p(w)   = (c(w) + 0.5) / (N + 0.5 (V + 1))
    state arc     p(w|v) = (c(v,w) + k p(w|v')) / (c(v) + k)      where c(v,w) > 0
    failure arc   b(v)   = k / (c(v) + k)

so each state's probabilities add up to one (hierarchical Dirichlet smoothing). A text is traversed once from
left to right: the automaton is in one state, a token takes the state's arc, or failure arcs until some state has one,
and the state that the arc leads to is carried to the next token (`Automaton`). Many stretches of texts step in lockstep.

Neither texts nor counts are gathered anywhere. Texts are tokenised into blocks of bounded size, and a block
asks for the counts of its own distinct n-grams, so it gets exactly the part of the automaton that its texts reach.
Asking is a radix exchange of fixed fan-out: a block's sorted n-grams are cut into FAN_OUT ranges of hashes. Where a
range of the whole corpus fits into one task, that task adds up and answers. Where it does not, FAN_OUT blocks' shares of a
range are merged into one, which asks in the same way one level below and passes on what it is told. So rows are
FAN_OUT for each block and level, levels are the logarithm of the corpus, and no task grows with it. Frequent words and hot
sources cost one entry per block.

Words are known by 64-bit hashes; longer n-grams by 48 bits beyond those of the lowest range (a chance of about 1e-8
for one to be mixed up with another).

Defined results: a null text counts as empty; an empty text is the end token alone; a null id is
never held out; repeated rows train and score as often as they come; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import claim_worker, slices, written

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
END = b""  # no word is empty
LONG_BITS = 48
#: Ranges that each block, or merged share of blocks, is cut into.
FAN_BITS = 6
#: Tokens of a text that are traversed in one stretch.
STRETCH = 512
#: Partitions of an exchange at most; beyond, a task answers several ranges one after the other.
MOST_PARTS = 50_000
#: A partition has about as many keys, if its ranges are small.
PART_KEYS = 1_000_000


def _squeeze(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of whole numbers as compressed byte planes."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _expand(data: bytes, n: int, width: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _width(values: np.ndarray) -> int:
    return max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def held_out(doc: int | None, folds: int, fold: int) -> bool:
    return doc is not None and zlib.crc32(str(doc).encode()) % folds == fold


@dataclass
class Grams:
    """Distinct n-grams of one length in a block: hashes by local number, the number that each token ends (-1 for
    none), the hashes in ascending order with their training counts, and each number's rank in that order."""

    hashes: np.ndarray
    of_token: np.ndarray
    sorted_hashes: np.ndarray
    counts: np.ndarray
    rank: np.ndarray
    n: int

    def totals(self, told: np.ndarray) -> np.ndarray:
        """Counts in the order of the sorted hashes as counts by local number; what only asking needs is let go."""
        found = told[self.rank].astype(np.float64) if self.n else np.zeros(0)
        self.hashes = self.sorted_hashes = self.counts = self.rank = np.zeros(0)
        return found


class Block:
    """Tokens of some texts as local numbers, with the hashes of the local words; the end token is number 0."""

    FIELDS = "block long, docs array<long>, sizes array<int>, n_words int, width int, tokens binary, words binary, train_tokens long, train_docs long, n_tokens long"

    def __init__(self, docs: list, sizes: np.ndarray, tokens: np.ndarray, words: np.ndarray, folds: int, fold: int) -> None:
        self.docs, self.sizes, self.tokens, self.words = docs, sizes, tokens, words
        self.out = np.array([held_out(d, folds, fold) for d in docs], bool)
        self.train = np.repeat(~self.out, sizes)

    @classmethod
    def tokenise(cls, docs: list, texts: list, folds: int, fold: int) -> Block:
        number: dict[bytes, int] = defaultdict(count().__next__)
        number[END]
        rows = []
        for t in texts:
            own = ("" if t is None else t).encode().translate(_LOWER).split()
            own.append(END)
            rows.append(np.fromiter(map(number.__getitem__, own), np.int64, len(own)))
        tokens = np.concatenate(rows)
        words = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
        # Frequent words get small numbers, which pack better.
        rank = np.argsort(-np.bincount(tokens[tokens > 0], minlength=len(words))[1:], kind="stable") + 1
        place = np.zeros(len(words), np.int64)
        place[rank] = np.arange(1, len(words))
        return cls(docs, np.array([len(r) for r in rows], np.int64), place[tokens], np.concatenate([words[:1], words[rank]]), folds, fold)

    def row(self, block: int) -> tuple:
        width = _width(self.tokens)
        return (block, self.docs, self.sizes, len(self.words), width, _squeeze(self.tokens, width), _squeeze(self.words, 8), int(self.train.sum()), int((~self.out).sum()), len(self.tokens))

    @classmethod
    def of_row(cls, row: dict, folds: int, fold: int) -> Block:
        sizes = np.array(row["sizes"], np.int64)
        return cls(row["docs"], sizes, _expand(row["tokens"], int(sizes.sum()), row["width"]).astype(np.int64), _expand(row["words"], row["n_words"], 8), folds, fold)

    def grams(self, order: int) -> list[Grams]:
        """The n-grams of 1 to `order` tokens; a text's start is the word behind all others."""
        first = np.cumsum(self.sizes) - self.sizes
        place = np.arange(len(self.tokens)) - np.repeat(first, self.sizes)
        found, n = [], len(self.words) + 1
        for length in range(order):
            if length == 0:
                hashes, which = _mix(self.words), self.tokens
                has = np.ones(len(self.tokens), bool)
            else:
                has = place >= length - 1
                before = np.roll(found[-1].of_token, 1).astype(np.int64)
                known = found[-1].hashes
                if length == 1:
                    before[first] = len(self.words)
                    known = np.append(known, _mix(np.array([0x5354415254], np.uint64)))
                pairs, inverse = np.unique(before[has] * n + self.tokens[has], return_inverse=True)
                hashes = _mix(known[pairs // n] + self.words[pairs % n] * np.uint64(0x9E3779B97F4A7C15))
                which = np.full(len(self.tokens), -1, np.int32)
                which[has] = inverse
            by_hash = np.argsort(hashes)
            rank = np.empty(len(by_hash), np.int32)
            rank[by_hash] = np.arange(len(by_hash))
            counts = np.bincount(rank[which[has & self.train]], minlength=len(by_hash))
            found.append(Grams(hashes, which, hashes[by_hash], counts, rank, len(by_hash)))
        return found


def tokenised(df: DataFrame, folds: int, fold: int, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    names = [x.split()[0] for x in Block.FIELDS.split(", ")]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        claim_worker("ngram_lm")
        number = TaskContext.get().partitionId() << 24
        for b in slices(batches, "_text", block_bytes):
            block = Block.tokenise(b.column("_id").to_pylist(), b.column("_text").to_pylist(), folds, fold)
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(block.row(number), kinds)], names=names)
            number += 1

    return df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, Block.FIELDS)


ASK = "kind int, range long, asker long, n int, key_width int, keys binary, width int, counts binary"
ASK_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]
ANSWER = "kind int, range long, asker long, n int, width int, counts binary, distinct long"
ANSWER_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64()]


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


@dataclass(frozen=True)
class Radix:
    """Ranges of hashes by levels: a level splits each range of the one above into 2 ** `fan_bits`."""

    levels: int
    fan_bits: int = FAN_BITS

    @classmethod
    def of(cls, entries: int, range_keys: int, fan_bits: int = FAN_BITS) -> Radix:
        """As many levels as ranges of at most `range_keys` of the blocks' entries take, if hashes spread evenly."""
        levels = 1
        while entries > range_keys << (fan_bits * levels):
            levels += 1
        return cls(levels, fan_bits)

    @property
    def ranges(self) -> int:
        return 1 << (self.fan_bits * self.levels)

    def kept(self, kind: int) -> int:
        """Bits of a hash that keys have."""
        return 64 if kind == 0 else min(64, LONG_BITS + self.fan_bits * self.levels)

    def requests(self, kind: int, above: int, asker: int, keys: np.ndarray, counts: np.ndarray, level: int) -> list[tuple]:
        """Rows of ASK for the ranges of a level inside range `above` of the one over it; `keys` ascend."""
        low = self.kept(kind) - self.fan_bits * level
        starts = np.array([((above << self.fan_bits) + i) << low for i in range(1 << self.fan_bits)], np.uint64)
        edges = [*np.searchsorted(keys, starts).tolist(), len(keys)]
        rows = []
        for i, (at, to) in enumerate(zip(edges, edges[1:])):
            if at < to:
                steps = np.diff(keys[at:to], prepend=starts[i])
                rows.append((kind, (above << self.fan_bits) + i, asker, to - at, _width(steps), _squeeze(steps, _width(steps)), _width(counts[at:to]), _squeeze(counts[at:to], _width(counts[at:to]))))
        return rows

    def read(self, asked: list[dict], level: int) -> tuple[np.ndarray, np.ndarray]:
        """(keys, counts) of requests, one after the other."""
        keys = [np.cumsum(_expand(r["keys"], r["n"], r["key_width"]), dtype=np.uint64) + np.uint64(r["range"] << (self.kept(r["kind"]) - self.fan_bits * level)) for r in asked]
        return np.concatenate(keys), np.concatenate([_expand(r["counts"], r["n"], r["width"]) for r in asked])


def _merged(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in ascending order, the place of each key among them)."""
    order = np.argsort(keys, kind="stable")
    fresh = np.ones(len(keys), bool)
    fresh[1:] = np.diff(keys[order]) != 0
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(fresh) - 1
    return keys[order][fresh], which


def _added(which: np.ndarray, n: int, counts: np.ndarray) -> np.ndarray:
    total = np.zeros(n, np.uint64)
    np.add.at(total, which, counts)
    return total


def _told(asked: list[dict], every: np.ndarray, distinct: int) -> pa.Table:
    """Rows of ANSWER to requests, from the total counts of all their keys; `distinct` goes with the first."""
    rows, at = [], 0
    for i, r in enumerate(asked):
        own = every[at : at + r["n"]]
        at += r["n"]
        rows.append((r["kind"], r["range"], r["asker"], r["n"], _width(own), _squeeze(own, _width(own)), 0 if i else distinct))
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), ANSWER_KINDS)], names=_names(ANSWER))


def _by_range(asked: DataFrame, ranges: int, orders: int, entries: int) -> DataFrame:
    """Ranges in partitions addressed by number: one each, as far as MOST_PARTS goes, or several where they are small."""
    parts = min(ranges * orders, MOST_PARTS, max(8, orders * entries // PART_KEYS))
    part = F.pmod(F.col("kind") * F.lit(ranges).cast("long") + F.col("range"), F.lit(parts).cast("long")).cast("int")
    return asked.withColumn("part", part).repartitionById(parts, F.col("part"))


def resolved(asked: DataFrame, radix: Radix, level: int, askers: int, orders: int, entries: int) -> tuple[DataFrame, int]:
    """(ANSWER to each request of the level, number of distinct words with a training count); a range has at most `askers` requests."""
    if level == radix.levels:

        def totals(group: pa.Table) -> pa.Table:
            rows = group.select(_names(ASK)).to_pylist()
            keys, counts = radix.read(rows, level)
            distinct, which = _merged(keys)
            total = _added(which, len(distinct), counts)
            return _told(rows, total[which], int(np.count_nonzero(total)))

        told = written(_by_range(asked, radix.ranges, orders, entries).groupBy("part", "kind", "range").applyInArrow(totals, ANSWER), "lm-counts")
        return told, told.where("kind = 0").agg(F.sum("distinct")).first()[0] or 0

    nodes = -(-askers >> radix.fan_bits)
    asked = written(asked, f"lm-asked-{level}")
    parts = min(max(1, orders * nodes << (radix.fan_bits * level)), MOST_PARTS)
    keys_ = ("kind", "range", "node")
    shares = asked.withColumn("node", F.pmod(F.xxhash64("asker"), F.lit(nodes).cast("long"))).repartition(parts, *keys_)

    def merge(group: pa.Table) -> pa.Table:
        rows = group.select(_names(ASK)).to_pylist()
        keys, counts = radix.read(rows, level)
        distinct, which = _merged(keys)
        below = radix.requests(rows[0]["kind"], rows[0]["range"], group.column("node")[0].as_py(), distinct, _added(which, len(distinct), counts), level + 1)
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*below), ASK_KINDS)], names=_names(ASK))

    told, v = resolved(shares.groupBy(*keys_).applyInArrow(merge, ASK), radix, level + 1, nodes, orders, entries)

    def pass_on(group: pa.Table, told: pa.Table) -> pa.Table:
        rows = group.select(_names(ASK)).to_pylist()
        distinct, which = _merged(radix.read(rows, level)[0])
        parts = sorted(told.select(["below", "n", "width", "counts"]).to_pylist(), key=lambda r: r["below"])
        total = np.concatenate([_expand(r["counts"], r["n"], r["width"]) for r in parts])
        return _told(rows, total[which], 0)

    above = told.select("kind", F.shiftright("range", radix.fan_bits).alias("range"), F.col("asker").alias("node"), F.col("range").alias("below"), "n", "width", "counts").repartition(parts, *keys_)
    return written(shares.groupBy(*keys_).cogroup(above.groupBy(*keys_)).applyInArrow(pass_on, ANSWER), f"lm-told-{level}"), v


def requests(blocks: DataFrame, radix: Radix, order: int, folds: int, fold: int) -> DataFrame:
    """ASK for the training counts of each block's n-grams; `kind` is an n-gram's length less one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("ngram_lm")
        for b in batches:
            for row in (r for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
                block = Block.of_row(row, folds, fold)
                for kind, grams in enumerate(block.grams(order)):
                    keys = grams.sorted_hashes >> np.uint64(64 - radix.kept(kind))
                    rows = radix.requests(kind, 0, row["block"], keys, grams.counts, 1)
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), ASK_KINDS)], names=_names(ASK))

    return blocks.select("block", "docs", "sizes", "n_words", "width", "tokens", "words").mapInArrow(run, ASK)


class Automaton:
    """The states and arcs that a block's texts reach.

    State 0 is the root, state 1 the start of a text, then come the block's n-grams of 1 to order - 1 tokens. `keys` has
    state * words + token of each arc in ascending order, `weights` and `targets` what it costs and where it leads;
    `fails` and `fail_weights` are the failure arcs. The root has an arc for every token.
    """

    def __init__(self, block: Block, grams: list[Grams], totals: list[np.ndarray], n: int, v: int, n_texts: int, prior: float) -> None:
        self.words, order = len(block.words), len(grams)
        first = np.cumsum(block.sizes) - block.sizes
        base = np.cumsum([2, *(g.n for g in grams[: order - 1])])  # state of the first n-gram of each length
        states = int(base[-1]) if order > 1 else 2
        visits = np.zeros(states)
        visits[1] = n_texts
        self.fails = np.zeros(states, np.int32)
        chance = (totals[0] + 0.5) / (n + 0.5 * (v + 1))
        self.root_weights = np.log10(chance)
        self.root_targets = np.where(totals[0] > 0, base[0] + np.arange(len(totals[0])), 0) if order > 1 else np.zeros(len(totals[0]), np.int64)
        arcs = []
        for length in range(1, order):
            shorter, longer = grams[length - 1], grams[length]
            visits[base[length - 1] : base[length - 1] + shorter.n] = totals[length - 1]
            at = np.flatnonzero(longer.of_token >= 0).astype(np.int32)
            own = longer.of_token[at]
            state, suffix, token = (np.zeros(longer.n, np.int32) for _ in range(3))
            before = np.roll(shorter.of_token, 1) + base[length - 1]
            if length == 1:
                before[first] = 1
            state[own], suffix[own], token[own] = before[at], shorter.of_token[at], block.tokens[at]
            del at, own, before
            # An n-gram that occurs in training has a state before its last token, and so has its end.
            chance = (totals[length] + prior * chance[suffix]) / (visits[state] + prior)
            real = np.flatnonzero(totals[length] > 0)
            keys = state[real] * np.int64(self.words) + token[real]
            del state, token
            by_key = np.argsort(keys)
            keys, real = keys[by_key], real[by_key]
            del by_key
            if length < order - 1:
                self.fails[base[length] : base[length] + len(suffix)] = base[length - 1] + suffix
                targets = base[length] + real
            else:
                targets = base[length - 1] + suffix[real]
            # States of longer contexts have higher numbers, so all keys ascend.
            arcs.append((keys, np.log10(chance[real]), targets.astype(np.int32)))
        self.fail_weights = np.log10(prior / (visits + prior))
        arcs.append((np.array([np.iinfo(np.int64).max]), np.zeros(1), np.zeros(1, np.int32)))
        self.keys, self.weights, self.targets = (np.concatenate(x) for x in zip(*arcs))
        self.order, self.start = order, int(order > 1)

    def step(self, states: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 weight of reading a token in each state, the states after it)."""
        weight, after, states = np.zeros(len(states)), np.zeros(len(states), np.int64), states.copy()
        left = np.arange(len(states))
        while len(left):
            own = states[left]
            key = np.where(own > 0, own * np.int64(self.words) + tokens[left], -1)
            arc = np.searchsorted(self.keys, key)
            hit, root = self.keys[arc] == key, own == 0
            taken = left[hit]
            weight[taken] += self.weights[arc[hit]]
            after[taken] = self.targets[arc[hit]]
            taken = left[root]
            weight[taken] += self.root_weights[tokens[taken]]
            after[taken] = self.root_targets[tokens[taken]]
            left = left[~hit & ~root]
            weight[left] += self.fail_weights[states[left]]
            states[left] = self.fails[states[left]]
        return weight, after

    def traverse(self, tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Weight of each token's step. Long texts are cut into stretches; the state depends on the order - 1 tokens before
        only, so a stretch that does not start its text reads those first, from the root."""
        steps = np.zeros(len(tokens))
        pieces = -(-sizes // STRETCH)
        text = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = (np.cumsum(sizes) - sizes)[text] + nth * STRETCH
        length = np.minimum(sizes[text] - nth * STRETCH, STRETCH)
        longest = np.argsort(-length, kind="stable")
        begin, length, nth = begin[longest], length[longest], nth[longest]
        states = np.where(nth == 0, self.start, 0)
        inner = np.flatnonzero(nth > 0)
        for back in range(self.order - 1, 0, -1):
            states[inner] = self.step(states[inner], tokens[begin[inner] - back])[1]
        for j in range(int(length[0]) if len(length) else 0):
            going = np.searchsorted(-length, -j)  # those with a token left
            at = begin[:going] + j
            steps[at], states[:going] = self.step(states[:going], tokens[at])
        return steps


def traverse(block: Block, grams: list[Grams], totals: list[np.ndarray], n: int, v: int, n_texts: int, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """(log10 weight of each token's step through the automaton, log10 weight at the root).

    `totals` has the training counts of each length's n-grams by local number.
    """
    automaton = Automaton(block, grams, totals, n, v, n_texts, prior)
    return automaton.traverse(block.tokens, block.sizes), automaton.root_weights[block.tokens]


def score(df: DataFrame, order: int = 3, folds: int = 5, fold: int = 1, prior: float = 100.0, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8 << 20, range_keys: int = 4_000_000, fan_bits: int = FAN_BITS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Rows whose crc32(id as text) mod `folds` is not `fold` train the model. `order` is n, `prior` is k above.
    """
    blocks = written(tokenised(df, folds, fold, id_col, text_col, block_bytes), "lm-blocks")
    facts = blocks.agg(F.sum("n_tokens").alias("tokens"), F.sum("train_tokens").alias("n"), F.sum("train_docs").alias("texts"), F.count(F.lit(1)).alias("blocks"), (F.max(F.shiftright("block", 24)) + 1).alias("tasks"), (F.max(F.col("block").bitwiseAND(F.lit((1 << 24) - 1))) + 1).alias("most")).first()
    radix = Radix.of(facts["tokens"] or 0, range_keys, fan_bits)
    answers, v = resolved(requests(blocks, radix, order, folds, fold), radix, 1, max(1, facts["blocks"]), order, facts["tokens"] or 0)
    n, texts = facts["n"] or 0, facts["texts"] or 0
    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def scored(asked: pa.Table, told: pa.Table) -> pa.Table:
        claim_worker("ngram_lm")
        rows: list[pa.Table] = []
        parts = sorted(told.select(["kind", "range", "n", "width", "counts"]).to_pylist(), key=lambda r: (r["kind"], r["range"]))
        for row in asked.to_pylist():
            block = Block.of_row(row, folds, fold)
            grams, totals = block.grams(order), []
            for kind in range(order):
                told_of = [_expand(p["counts"], p["n"], p["width"]) for p in parts if p["kind"] == kind]
                totals.append(grams[kind].totals(np.concatenate(told_of) if told_of else np.zeros(0)))
            steps, base = traverse(block, grams, totals, n, v, texts, prior)
            starts = np.cumsum(block.sizes) - block.sizes
            known = np.add.reduceat((totals[0][block.tokens] > 0).astype(np.int64), starts)
            columns = [block.docs, block.out, block.sizes, known, np.full(len(starts), n), np.add.reduceat(base, starts), np.add.reduceat(steps, starts)]
            rows.append(pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names))
        return pa.concat_tables(rows)

    # A partition for each block, addressed by number, unless few tasks have most of the blocks.
    tasks, parts = facts["tasks"] or 1, min(max(1, (facts["tasks"] or 1) * (facts["most"] or 1)), 2 * facts["blocks"] + 1, MOST_PARTS)
    part = F.pmod(F.col("block").bitwiseAND(F.lit((1 << 24) - 1)) * tasks + F.shiftright("block", 24), F.lit(parts).cast("long")).cast("int")
    held = blocks.select("block", "docs", "sizes", "n_words", "width", "tokens", "words", part.alias("part")).repartitionById(parts, F.col("part"))
    told = answers.withColumnRenamed("asker", "block").select("block", "kind", "range", "n", "width", "counts", part.alias("part")).repartitionById(parts, F.col("part"))
    return held.groupBy("part", "block").cogroup(told.groupBy("part", "block")).applyInArrow(scored, f"{id_col} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
