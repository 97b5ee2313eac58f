import math
import zlib
from collections import Counter

import numpy as np

from larkspur.llm import ngram_lm
from larkspur.llm.common import _CLEANUP, written
from tests.llm.fixtures import documents, key, lower, rows, words


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 5 == 1


def brute(given, prior, order):
    """An automaton of dictionaries, traversed token by token with failure arcs."""
    tokens = [(d, [*words(lower(t)), ""]) for d, t, *_ in given]
    count, arcs, visits = Counter(), [Counter() for _ in range(order)], Counter()
    for d, own in tokens:
        if not held(d):
            count.update(own)
            run = [None, *own]
            for i in range(1, len(run)):
                for length in range(1, order):
                    if i >= length:
                        context = tuple(run[i - length : i])
                        visits[context] += 1
                        arcs[length][context, run[i]] += 1
    n, v = sum(count.values()), len(count)
    p = {w: (count[w] + 0.5) / (n + 0.5 * (v + 1)) for _, own in tokens for w in own}

    def weight(context, w):
        if not context:
            return math.log10(p[w])
        if not visits[context]:
            return weight(context[1:], w)
        c = arcs[len(context)][context, w]
        if c:
            return math.log10((c + prior * 10 ** weight(context[1:], w)) / (visits[context] + prior))
        return math.log10(prior / (visits[context] + prior)) + weight(context[1:], w)

    for d, own in tokens:
        base = sum(math.log10(p[w]) for w in own)
        run, score = [None, *own], 0.0
        for i in range(1, len(run)):
            score += weight(tuple(run[max(0, i - order + 1) : i]), run[i])
        yield d, held(d), len(own), sum(count[w] > 0 for w in own), n, base, score


def test_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "STRETCH", 7)
    for order, block_bytes, range_keys, fan_bits in ((3, 1 << 20, 4_000_000, 6), (3, 3000, 50, 3), (2, 3000, 500, 2), (1, 3000, 50, 6), (4, 3000, 500, 4)):
        got = ngram_lm.score(documents(spark), order, prior=100.0, block_bytes=block_bytes, range_keys=range_keys, fan_bits=fan_bits).collect()
        expected = sorted(brute(rows(), 100.0, order), key=lambda r: key(r[:5] + (round(r[5], 4),)))
        got = sorted(map(tuple, got), key=lambda r: key(r[:5] + (round(r[5], 4),)))
        assert [r[:5] for r in got] == [r[:5] for r in expected]
        assert np.allclose([r[5:] for r in got], [r[5:] for r in expected], atol=1e-6)


def test_each_state_is_a_distribution():
    """Steps out of one state to every word and to an unknown one add up to one."""
    given = [(2, "a b a c a b a b c"), (4, "b b a b a")]
    vocabulary = ["a", "b", "c", "", "unknown"]
    assert not any(held(d) for d, _ in given)
    for context in ("a", "a b", "b a", "c", "zz", ""):
        blocks = [ngram_lm.Block.tokenise([d], [t], 5, 1) for d, t in given]
        total = 0.0
        for w in vocabulary:
            text = f"{context} {w}".strip()
            block = ngram_lm.Block.tokenise([d for d, _ in given] + [None], [t for _, t in given] + [text], 5, 1)
            block.train[sum(b.sizes[0] for b in blocks) :] = False
            grams = block.grams(3)
            totals = [g.counts[g.rank].astype(float) for g in grams]
            n = totals[0].sum()
            steps, _ = ngram_lm.traverse(block, grams, totals, n, int((totals[0] > 0).sum()), len(given), 7.0)
            at = block.sizes[:-1].sum() + len(context.split())
            total += 10.0 ** steps[at]
        assert math.isclose(total, 1.0)


def test_levels_keep_ranges_bounded_and_rows_linear():
    for entries in (0, 1, 10**8, 10**10, 10**13):
        radix = ngram_lm.Radix.of(entries, 4_000_000)
        assert entries <= 4_000_000 * radix.ranges
        assert radix.levels == 1 or entries > 4_000_000 * radix.ranges >> radix.fan_bits
        keys = np.sort(np.random.default_rng(0).integers(0, 2**63, 5000, np.uint64) >> np.uint64(64 - radix.kept(1)))
        rows = radix.requests(1, 0, 9, keys, np.ones(5000, np.uint64), 1)
        assert len(rows) <= 1 << radix.fan_bits
        read, counts = radix.read([dict(zip(ngram_lm._names(ngram_lm.ASK), r)) for r in rows], 1)
        assert (read == keys).all() and counts.sum() == 5000


def test_planes_round_trip():
    for values in (np.array([0], np.uint64), np.array([2**64 - 1, 5], np.uint64), np.arange(70_000, dtype=np.uint64)):
        width = ngram_lm._width(values)
        assert (ngram_lm._expand(ngram_lm._squeeze(values, width), len(values), width) == values).all()


def test_bigram_context_beats_the_base_on_held_out_texts(spark):
    text = "one two three four five six seven eight nine ten "
    got = ngram_lm.score(documents(spark, [(i, text * 3, "en", "s", 1) for i in range(60)])).where("held_out").collect()
    assert got and all(r.score > r.base_score for r in got)


def test_empty_table(spark):
    assert ngram_lm.score(documents(spark).where("false")).count() == 0


def test_asking_leaves_no_shuffle_files(spark, monkeypatch):
    """When the table of counts is written, the exchange of requests is off the disk before texts and answers are shuffled."""
    registered = lambda: spark._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()
    option, seen = spark.conf.get(_CLEANUP, None), []

    def watched(df, label):
        before = registered()
        told = written(df, label)
        seen.append((label, registered() - before, spark.conf.get(_CLEANUP, None)))
        return told

    monkeypatch.setattr(ngram_lm, "written", watched)
    assert ngram_lm.score(documents(spark)).count() == len(rows())
    assert [x[0] for x in seen] == ["lm-blocks", "lm-counts"]
    assert max(x[1] for x in seen) <= 0, seen
    assert {x[2] for x in seen} == {option}, (seen, option)
