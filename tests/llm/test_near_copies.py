"""Meetings of texts: each pair comes from one of them, and none is lost."""

import numpy as np
import pyarrow as pa

from ledgerlens.llm import near_copies as N


def meetings(own):
    """Batches of whole meetings, one each, of texts with these first shingles; all of one size, each its own component."""
    head = {t: (sorted(s) + [(1 << 63) - 1] * N.HEAD)[: N.HEAD] for t, s in own.items()}
    marks = {t: int(np.bitwise_or.reduce([np.int64(1) << np.int64(x % 62) for x in s])) for t, s in own.items()}
    for s in sorted(set().union(*own.values())):
        here = [t for t in sorted(own) if s in own[t]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v) for v in ([s] * len(here), np.full(len(here), 100, np.int32), here, here, [len(own[t]) for t in here], [marks[t] for t in here])] + [pa.array([head[t] for t in here], pa.list_(pa.int64()))],
            names=["s", "n", "node", "label", "w", "marks", "head"],
        )


def pairs(own):
    out = list(N._by_shingle(N._other_pairs)(meetings(own)))
    return [(a, b) for x in out for a, b in zip(x.column("a").to_pylist(), x.column("b").to_pylist())]


def test_texts_that_meet_often_are_paired_once():
    # 40 texts with 20 common first shingles: 780 pairs, which came from each of 20 meetings
    got = pairs({t: set(range(1, 21)) for t in range(40)})
    assert sorted(got) == [(a, b) for a in range(40) for b in range(a + 1, 40)]


def test_no_pair_is_lost_to_an_earlier_meeting():
    r = np.random.default_rng(3)
    # heads that overlap in all, some or none of their shingles, short ones too; negative hashes come first
    own = {t: set((r.choice(60, int(r.integers(1, 40)), replace=False) - 30).tolist()) for t in range(60)}
    got = pairs(own)
    # the bound on what two texts share is that of the operator, at its loosest
    rest = -(-N.SHARE * 100 // N.OF) - 1
    need = {(a, b) for a in own for b in own if a < b and own[a] & own[b] and (len(own[a] & own[b]) + rest) * (N.SHARE + N.OF) >= 200 * N.SHARE}
    assert need <= set(got) and len(need) > 100
    assert len(got) < 2 * len(set(got))
