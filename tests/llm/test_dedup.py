import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tessera.llm import components, exact_dedup, simhash

from .fixtures import DOCS, docs, prose, rows_of


def _normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def _brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(_normal(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[_normal(t)]
        keep = min((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(_normal(t).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("salts", [1, 32])
def test_exact_groups(spark, salts):
    got = exact_dedup.exact_groups(docs(spark).repartition(5), salts=salts)
    assert rows_of(got) == _brute_exact(DOCS)


def test_exact_groups_when_digests_collide(spark):
    weak = exact_dedup.exact_groups(docs(spark).repartition(3), digest=lambda t: F.length(t) % 3)
    assert rows_of(weak) == _brute_exact(DOCS)


def test_exact_empty_table(spark):
    assert exact_dedup.exact_groups(docs(spark, [])).collect() == []
    assert exact_dedup.drop_exact_copies(docs(spark, [])).columns == docs(spark, []).columns


def test_drop_exact_copies_keeps_columns(spark):
    got = exact_dedup.drop_exact_copies(docs(spark))
    assert got.columns == docs(spark).columns
    assert sorted(r["doc_id"] or 0 for r in got.collect()) == [0, 1, 4, 5, 7, 8, 9, 11, 12, 13, 14]


def test_repeated_rows_leave_one(spark):
    one, two = prose(1, 300), prose(2, 300)
    rows = [(10, one), (10, one), (10, two), (11, one), (None, one), (None, "alone here"), (None, "alone here"), (12, None), (12, "")]
    want = [("None", "alone here"), ("10", one), ("10", two), ("12", "")]
    for drop in (exact_dedup.drop_exact_copies, simhash.drop_near_copies):
        got = drop(docs(spark, rows).repartition(3))
        assert got.columns == docs(spark).columns
        assert sorted((str(r[0]), r[1] or "") for r in got.collect()) == sorted(want)


def test_exact_dedup_runs_no_python(spark):
    plan = exact_dedup.exact_groups(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def _brute_print(t):
    words = (t or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)) if hashes else 0


def _brute_components(prints):
    prints = np.array(prints, np.uint64)
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= 3) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_near_duplicate_components(spark):
    near = [(100 + i, prose(9, 400) + f" extra{i}") for i in range(40)]
    rows = [r for r in DOCS if r[0] is not None] + near
    prints = [_brute_print(t) for _, t in rows]
    roots = _brute_components(prints)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        least[r] = min(i, least.get(r, i))
    want = sorted(((i, f"{p:016x}", least[r]) for (i, _), p, r in zip(rows, prints, roots, strict=True)), key=repr)
    assert rows_of(simhash.near_duplicate_components(docs(spark, rows))) == want


def test_near_duplicates_of_an_empty_table(spark):
    assert simhash.near_duplicate_components(docs(spark, [])).collect() == []


def test_spark_hash_agrees(spark):
    row = spark.createDataFrame([("one two three",)], "s string").select(F.xxhash64("s")).first()[0]
    assert row & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"one two three", 42)


@pytest.mark.parametrize("pairwise", [4, 2_048])
def test_links_connect_as_all_pairs_do(spark, monkeypatch, pairwise):
    """Random fingerprints in dense balls and chains; a small PAIRWISE sends lists through probing."""
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    rng = np.random.default_rng(5)
    prints = set()
    for _ in range(30):
        x = int(rng.integers(1 << 63))
        for _ in range(20):
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= 1 << int(b)
            prints.add(x)
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    links = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    roots = _brute_components(prints)
    mine = {}
    for p, r in zip(signed, roots, strict=True):
        mine.setdefault(r, set()).add(got.get(p, p))
    assert all(len(s) == 1 for s in mine.values())
    assert len({next(iter(s)) for s in mine.values()}) == len(mine)


def test_list_links_by_probing_equal_pairs():
    rng = np.random.default_rng(6)
    mask = simhash._masks(3)[0]
    free = [b for b in range(64) if not mask >> b & 1]
    fps = np.unique(np.array([sum(1 << b for b in free if rng.random() < 0.12) for _ in range(3000)], np.uint64))

    def classes(limit):
        old, simhash.PAIRWISE = simhash.PAIRWISE, limit
        try:
            a, b = simhash._list_links(fps, mask, 3)
        finally:
            simhash.PAIRWISE = old
        root = {int(f): int(f) for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for x, y in zip(a, b, strict=True):
            p, q = find(int(x)), find(int(y))
            root[max(p, q)] = min(p, q)
        return [find(int(f)) for f in fps]

    assert classes(10) == classes(10**9)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(50)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[1000 + i] for i in range(50)} == {1000}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_drop_near_copies(spark):
    got = simhash.drop_near_copies(docs(spark, [(1, prose(1, 300)), (2, prose(1, 300)), (3, prose(2, 300)), (3, prose(1, 300))]))
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 3]


def test_tally_rejects_pairs_of_a_list(spark):
    """Pairs that share four positional bytes meet in a list; the count filter lets go of them before any bit is compared."""
    rng = np.random.default_rng(8)
    base = rng.integers(1 << 62, size=400).astype(np.uint64)
    other = base ^ np.uint64(0x0101010100000000)  # four bits, one in each of four bytes
    near = base ^ np.uint64(0x0000000700000000)
    assert (simhash._tally(base, other) == 4).all() and (simhash._tally(base, near) == 7).all()
    assert not simhash._linked(base, other, 3).any() and simhash._linked(base, near, 3).all()
    for x in rng.integers(0, 400, 20):
        assert simhash._tally(base[x], base[7]) == sum((int(base[x]) >> 8 * p & 255) == (int(base[7]) >> 8 * p & 255) for p in range(8))
    shared_lists = sum(int(base[0]) & m == int(other[0]) & m for m in simhash._masks(3))
    assert shared_lists == 1
    both = np.concatenate([base, other]).view(np.int64).tolist()
    assert simhash.fingerprint_links(spark.createDataFrame([(p,) for p in both], "fp long")).count() == 0
