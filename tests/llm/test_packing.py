from __future__ import annotations

import random

import pytest

from cohortspark.llm import packing
from cohortspark.llm.packing import plan


def total(p):
    out = {}
    for n, pattern in p.groups:
        for s, m in pattern:
            out[s] = out.get(s, 0) + n * m
    return out


def optimum(items, capacity):
    items, best = sorted(items, reverse=True), len(items)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for room in set(bins):
            if room >= items[i]:
                bins.remove(room)
                place(i + 1, [*bins, room - items[i]])
                bins.append(room)
        place(i + 1, [*bins, capacity - items[i]])

    place(0, [])
    return best


def test_dominance_never_costs_a_sequence():
    rng, worse = random.Random(1), 0
    for _ in range(600):
        capacity, h = rng.choice([10, 12, 20, 30]), {}
        for _ in range(rng.randint(0, 7)):
            s = rng.randint(1, capacity)
            h[s] = h.get(s, 0) + 1
        p = plan(h, capacity)
        assert total(p) == h and all(sum(s * m for s, m in pattern) <= capacity for _, pattern in p.groups)
        best = optimum([s for s, n in h.items() for _ in range(n)], capacity)
        rest, done = dict(h), 0
        for n, pattern in p.groups:
            if done >= p.n_fixed:
                break
            done += n
            for s, m in pattern:
                rest[s] -= n * m
        assert done + optimum([s for s, n in rest.items() for _ in range(n)], capacity) == best
        worse += sum(n for n, _ in p.groups) > best
    assert worse <= 6


def test_large_instance_is_small_and_full():
    rng = random.Random(2)
    h = {s: rng.randint(0, 10**9) // s for s in range(1, 2049)}
    p = plan(h, 2048)
    assert total(p) == {s: n for s, n in h.items() if n}
    assert len(p.groups) < 3 * 2048
    assert sum(n for n, _ in p.groups) <= 1.001 * sum(s * n for s, n in h.items()) / 2048 + 1


def test_bad_sizes_are_refused():
    with pytest.raises(ValueError):
        plan({11: 1}, 10)


@pytest.mark.parametrize("sizes", [[], [0, 0, None], [5, 5, 5, 5, 10, 10, 25, 31, 3, 7, 10], [4] * 300 + [6] * 300])
def test_placed_pieces(spark, sizes):
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, n_tokens bigint")
    rows = packing.packed(df, 10).collect()
    seen = {}
    for r in rows:
        seen.setdefault(r.doc_id, []).append((r.token_start, r.n_tokens))
    for d, n in enumerate(sizes):
        pieces = sorted(seen.get(d, []))
        assert sum(p[1] for p in pieces) == (n or 0)
        assert len(pieces) == -(-(n or 0) // 10)
        assert all(a[0] + a[1] == b[0] for a, b in zip(pieces, pieces[1:]))
    used = {}
    for r in rows:
        for t in range(r.sequence_start, r.sequence_start + r.n_tokens):
            assert 0 <= t < 10 and (r.sequence_id, t) not in used
            used[r.sequence_id, t] = 1
    report = packing.fill_report(packing.packed(df, 10), 10).first()
    assert report.n_tokens == sum(n or 0 for n in sizes) and report.n_sequences == len({r.sequence_id for r in rows})


def test_token_counts(spark):
    texts = [None, "", "hello world", "<|endoftext|>", "ä" * 9000]
    got = {r.doc_id: r.n_tokens for r in packing.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got[0] == got[1] == 0 and got[2] == 2 and got[3] > 1 and got[4] > 100
