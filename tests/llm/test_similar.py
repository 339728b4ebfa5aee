"""Which nodes of the near-copy stage are weighed against each other."""

import numpy as np

from partlens.llm import similar
from partlens.llm.common import components

SETS, SIZE = 40, 200


def _rooted(spark, sets):
    rows = []
    for node, found in enumerate(sets):
        first = sorted(int(x) for x in found[: similar.prefix_size(found.size)])
        rows.append((node, node, found.size, first, [False] * len(first), similar.parities(found)))
    return spark.createDataFrame(rows, "node long, root long, size long, first array<long>, often array<boolean>, bits binary")


def _numbers(seed, n):
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.int64).astype(np.uint64)


def test_sets_that_share_a_rare_passage_only_do_not_meet(spark):
    shared = _numbers(0, 20)
    rooted = _rooted(spark, [np.concatenate([shared, _numbers(1 + k, SIZE - 20)]) for k in range(SETS)])
    assert similar._meeting(rooted).count() == 0


def test_the_nearest_are_no_more_than_the_rows_and_no_similar_pair_is_lost(spark):
    common = _numbers(0, SIZE - 10)
    rooted = _rooted(spark, [np.concatenate([common, _numbers(1 + k, 10)]) for k in range(SETS)])
    shared = similar._shared(rooted)
    # The prefixes hold the same shingles, so their nodes stand in one group, not in one for each shingle.
    assert shared.count() == SETS
    nearest = similar._meeting(rooted, shared, nearest=True)
    assert 0 < nearest.count() <= SETS
    assert similar._meeting(rooted, shared).count() == SETS * (SETS - 1) // 2
    rooted = similar._rooted(rooted.drop("root"), nearest)
    left = similar._meeting(rooted, shared)
    pairs = {(r.a, r.b) for d in (nearest, left) for r in d.collect()}
    links = spark.createDataFrame(sorted(pairs), "a long, b long")
    assert components(links).select("root").distinct().count() == 1
