import random

import numpy as np
import xxhash

from larkspur.llm import simhash, simhash_similar
from larkspur.llm.common import Scratch
from tests.llm.fixtures import documents, lower, ordered, rows, words


def fingerprint(text):
    own = words(lower(text))
    if not own:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(own[i : i + 3]), 42) for i in range(max(1, len(own) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(items, linked):
    """items: (id, thing); smallest reachable id of each item, by trying all pairs."""
    parent = list(range(len(items)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i][1], items[j][1]) or items[i][0] == items[j][0]:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(items):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return [least[find(i)] for i in range(len(items))]


def near_copies(n=250, words_=400, edits=5):
    """A crowd of near copies, so that crowded blocks occur."""
    r = random.Random(4)
    base = [f"w{r.randrange(900)}" for _ in range(words_)]
    found = []
    for i in range(n):
        own = list(base)
        for _ in range(r.randint(0, edits)):
            own[r.randrange(len(own))] = f"e{r.randrange(999)}"
        found.append((10_000 + i, " ".join(own), "en", "s", 1))
    return found


def test_equals_brute_force(spark):
    given = [(i if d is None else d, t, a, b, c) for i, (d, t, a, b, c) in enumerate(rows()) if d is not None] + near_copies()
    # Rows that share an id but not a text would be joined by it; give each text an id of its own.
    seen, unique = set(), []
    for k, r in enumerate(given):
        d = r[0] if r[0] not in seen else 50_000 + k
        seen.add(d)
        unique.append((d, *r[1:]))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(documents(spark, unique)).collect()}
    prints = {d: fingerprint(t) for d, t, *_ in unique}
    expected = components(list(prints.items()), lambda a, b: (a ^ b).bit_count() <= 2)
    assert got == {d: (f"{p:016x}", c) for (d, p), c in zip(prints.items(), expected)}
    assert len(set(expected)) < len(expected)


def test_nulls_and_empty_tables(spark):
    got = simhash.near_duplicates(documents(spark, [(None, "a b c", None, None, None), (5, None, None, None, None), (3, "", None, None, None)])).collect()
    assert ordered(got) == ordered([(None, f"{fingerprint('a b c'):016x}", None), (5, "0" * 16, 3), (3, "0" * 16, 3)])
    assert simhash.near_duplicates(documents(spark).where("false")).count() == 0


def test_any_two_bits_share_a_block():
    masks = simhash.block_masks(5, 2)
    for a in range(64):
        for b in range(64):
            assert any(not m & (1 << a | 1 << b) for m in masks)


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_similar_groups_equal_brute_force(spark):
    r = random.Random(6)
    given = near_copies(40, 300, 2)
    for i in range(25):  # far from the threshold on either side
        base = [f"v{r.randrange(5000)}" for _ in range(250)]
        given.append((100 + i, " ".join(base), "en", "s", 1))
        for k, edits in enumerate((1, 30)):
            own = list(base)
            for j in r.sample(range(len(own)), edits):
                own[j] = f"u{r.randrange(9999)}"
            given.append((1000 * (k + 1) + i, " ".join(own), "en", "s", 1))
    given += [(60_000, None, None, None, None), (60_001, " ", None, None, None), (60_002, "one two", None, None, None), (60_003, "one TWO", None, None, None)]
    sets = []
    for d, t, *_ in given:
        own = words(lower(t))
        sets.append((d, frozenset(" ".join(own[i : i + 5]) for i in range(max(1, len(own) - 4))) if own else frozenset()))
    expected = components(sets, lambda a, b: jaccard(a, b) >= 0.8)
    got = {x.id: x.component for x in simhash_similar.groups(documents(spark, given)).collect()}
    assert got == {d: c for (d, _), c in zip(sets, expected)}
    kept = simhash_similar.one_of_each(documents(spark, [*given, given[0], (None, "x", None, None, None)]))
    assert sorted(k.doc_id for k in kept.collect() if k.doc_id is not None) == sorted(set(expected))
    assert kept.where("doc_id is null").count() == 1


def short_pairs(copies=12):
    """(shared, own of each) shingles as pairs of texts around 0.8: runs of distinct words that share their first part."""
    found, i = [], 0
    for shared, a, b in ((4, 0, 1), (5, 0, 1), (6, 0, 1), (12, 1, 2), (20, 2, 3), (28, 3, 4), (3, 0, 1), (11, 1, 2), (19, 2, 3), (27, 3, 4), (280, 40, 40)):
        for _ in range(copies):
            base = [f"p{i}w{k}" for k in range(shared + 4)]
            for side, own in enumerate((a, b)):
                found.append((2 * i + side, " ".join([*base, *(f"p{i}s{side}w{k}" for k in range(own))]), "en", "s", 1))
            i += 1
    return found


def exact_components(given):
    sets = []
    for d, t, *_ in given:
        own = words(lower(t))
        sets.append((d, frozenset(" ".join(own[i : i + 5]) for i in range(max(1, len(own) - 4)))))
    return {d: c for (d, _), c in zip(sets, components(sets, lambda a, b: jaccard(a, b) >= 0.8))}


def test_short_pairs_at_the_threshold_are_found_and_no_others(spark):
    given = short_pairs()
    expected = exact_components(given)
    assert sum(d != c for d, c in expected.items()) == 6 * 12
    assert {x.id: x.component for x in simhash_similar.groups(documents(spark, given)).collect()} == expected


def test_texts_meet_classes_alike_with_and_without_a_broadcast(spark, monkeypatch):
    given = short_pairs(2)
    monkeypatch.setattr(simhash_similar, "MOST_BROADCAST", 0)
    assert {x.id: x.component for x in simhash_similar.groups(documents(spark, given)).collect()} == exact_components(given)


def test_clusters_in_chunks_give_the_same_components(spark):
    """A family of near copies of which some link to few others, in chunks far smaller than itself."""
    given = short_pairs(3) + near_copies(150, 100, 6)
    expected = exact_components(given)
    assert 1 < len({c for d, c in expected.items() if d >= 10_000}) < 140
    for most in (1024, 20):
        assert {x.id: x.component for x in simhash_similar.groups(documents(spark, given), most=most).collect()} == expected


def test_passages_that_all_share_do_not_gather_documents(spark):
    """Texts of 60 shared words and 200 of their own share many shingles and no block."""
    r = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    given = [(i, " ".join([*passage, *(f"x{r.randrange(10**6)}" for _ in range(200))]), "en", "s", 1) for i in range(300)]
    df = documents(spark, given)
    sets = simhash_similar._of_classes(df, simhash_similar._marked(df, 0.8, 5, "doc_id", "text", 1 << 20), 5, "doc_id", "text", 1 << 20, "id long, shingles array<long>", simhash_similar._whole)
    sized = sets.selectExpr("id", "shingles", "size(shingles) as size").selectExpr("*", "cast(size - ceil(0.8 * size) + 1 as bigint) as need")
    assert simhash_similar._clusters(sized, Scratch(spark)).isEmpty()
    assert all(x.id == x.component for x in simhash_similar.groups(df).collect())


def test_rows_dealt_for_a_family_are_linear(spark):
    """Each set of a family that is one component after the pivots is dealt once, and the pivots once a chunk."""
    base = [f"w{i}" for i in range(30)]
    given = [(i, " ".join([*base, f"t{i}"]), "en", "s", 1) for i in range(2000)]
    df = documents(spark, given)
    dealt = []
    compared = simhash_similar._compared
    try:
        simhash_similar._compared = lambda d, *rest: dealt.append(d.count()) or compared(d, *rest)
        got = simhash_similar.groups(df, most=50).collect()
    finally:
        simhash_similar._compared = compared
    assert {x.component for x in got} == {0}
    assert dealt == [2000 + 40 * simhash_similar.PIVOTS]


def test_symmetric_difference_decides_for_any_two_sizes():
    """Of every pair of small sets that is similar enough, one block at least is shared, in any order of shingles."""
    for n in range(1, 30):
        for m in range(n, 40):
            for c in range(n + 1):
                if c / (n + m - c) >= 0.8:
                    # c shared shingles, at worst behind all others of either set
                    assert simhash_similar.blocks_of(n, 0.8) > n - c and simhash_similar.blocks_of(m, 0.8) > m - c


def test_repeated_ids_and_rows(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    given = [(1, a, "en", "s", 1), (1, a, "en", "s", 1), (2, a + " more", "en", "s", 1), (3, b, "en", "s", 1), (3, a, "en", "s", 1), (4, b + " more", "en", "s", 1), (9, "other words altogether here now", "en", "s", 1)]
    assert {x.id: x.component for x in simhash_similar.groups(documents(spark, given)).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 9: 9}


def test_hubs_of_components(spark):
    from larkspur.llm import components

    r = random.Random(8)
    pairs = [(0, i) for i in range(1, 400)] + [(i, i + 1000) for i in range(1, 300)] + [(5000, i) for i in range(390, 420)] + [(i, i + 1) for i in range(6000, 6040)] + [(r.randrange(7000, 7100), r.randrange(7000, 7100)) for _ in range(60)]
    df = spark.createDataFrame(pairs, "a long, b long")
    plain = {x.node: x.component for x in components.connected_components(df).collect()}
    limits = components.HUB_LINKS, components.HUBS
    try:
        components.HUB_LINKS, components.HUBS = 3, 1000
        assert {x.node: x.component for x in components.connected_components(df).collect()} == plain
    finally:
        components.HUB_LINKS, components.HUBS = limits
    assert plain[5000] == 0 and plain[6040] == 6000
    assert components.connected_components(df.where("false")).count() == 0


def test_stage_links_by_blocks_and_hamming_distance_first(spark, monkeypatch):
    """Near copies come from fingerprints, joins on blocks and the Hamming distance; what differs in more bits is found after it, and nothing twice."""
    r = random.Random(11)
    base = [f"v{i}" for i in range(120)]
    given = [(i, " ".join([*base[:-1], f"t{i}"]), "en", "s", 1) for i in range(30)] + short_pairs(2)
    given = [(d + (0 if k < 30 else 1000), *x) for k, (d, *x) in enumerate(given)]
    r.shuffle(given)
    df, seen = documents(spark, given), {}
    for name in ("close_pairs", "checked_links", "_compared"):
        own = getattr(simhash_similar, name)
        monkeypatch.setattr(simhash_similar, name, lambda *a, _own=own, _name=name, **k: seen.setdefault(_name, _own(*a, **k).checkpoint()))
    got = {x.id: x.component for x in simhash_similar.groups(df).collect()}
    assert got == exact_components(given)
    prints = {x.id: x.fp & (1 << 64) - 1 for x in simhash_similar._marked(df, 0.8, 5, "doc_id", "text", 1 << 20).collect()}
    for d, t, *_ in given:
        own = set(simhash.shingle_hashes(t, 5, 42))
        assert prints[d] == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own))
    pairs = seen["close_pairs"].collect()
    assert pairs and all(((x.fp_a ^ x.fp_b) & (1 << 64) - 1).bit_count() <= 2 for x in pairs)
    near = {(x.a, x.b) for x in seen["checked_links"].collect()}
    after = {(x.a, x.b) for x in seen["_compared"].collect()}
    assert len([x for x in near if max(x) < 30]) > 10 and any(max(x) >= 1000 for x in after)
    assert not {frozenset(x) for x in near} & {frozenset(x) for x in after}
