import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from framewell.llm import bestfit
from framewell.llm.tokens import default_path

SCHEMA = "doc_id long, text string, source string, turn long, length long, `a.b` long"


def check(rows, texts, window):
    """Every id of every document once, bins gapless and not over full. Returns the bins' fill."""
    tok = Tokenizer.from_file(default_path())
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.document].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert sorted((p[0].doc_id is None, p[0].doc_id or 0) for p in pieces.values()) == sorted((i is None, i or 0) for i, _ in texts)
    left = [(i, t) for i, t in texts]
    for some in pieces.values():
        some.sort(key=lambda r: r.piece)
        ids = np.concatenate([np.frombuffer(r.ids, "<u2") for r in some]).astype("<u4")
        match = next(x for x in left if x[0] == some[0].doc_id and [*tok.encode(x[1] or "", add_special_tokens=False).ids, 1] == ids.tolist())
        left.remove(match)
        assert [r.piece for r in some] == list(range(len(some))) and [r.start for r in some] == list(range(0, len(ids), window))
        assert all(r.length == min(window, len(ids) - r.start) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in some)
    assert not left and sorted(bins) == list(range(len(bins)))
    fill = []
    for some in bins.values():
        at = 0
        for offset, n in sorted(some):
            assert offset == at
            at += n
        assert at <= window
        fill.append(at)
    return fill


def brute_fullest(lengths, room):
    sums = {0}
    for n in lengths:
        sums |= {s + n for s in sums if s + n <= room}
    return max(sums)


@pytest.mark.parametrize("seed", range(6))
def test_each_bin_is_filled_as_by_brute_force(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 61, 120).tolist() + [60] * 7 + [31] * 20
    histogram = {n: lengths.count(n) for n in set(lengths)}
    got = bestfit.plan(histogram, 60)
    bins = defaultdict(list)
    for n, count in histogram.items():
        for b, offset in zip(*got.place(n, np.arange(count)), strict=True):
            bins[int(b)].append((int(offset), n))
    assert sorted(bins) == list(range(got.bins))
    left = sorted(lengths, reverse=True)
    for b in range(got.bins):  # bin by bin: the longest left, and no fuller set with it
        held = [n for _, n in sorted(bins[b])]
        assert [o for o, _ in sorted(bins[b])] == np.cumsum([0, *held[:-1]]).tolist()
        assert max(held) == left[0] and sum(held) == left[0] + brute_fullest(left[1:], 60 - left[0])
        for n in held:
            left.remove(n)
    assert not left and got.bins <= -(-sum(lengths) // 60) + max(1, sum(n > 30 for n in lengths))


def test_patterns_do_not_grow_with_the_corpus():
    rng = np.random.default_rng(1)
    histogram = {int(n): int(c) for n, c in zip(range(1, 4097), rng.integers(1, 10**9, 4096))}
    got = bestfit.plan(histogram)
    total = sum(n * c for n, c in histogram.items())
    assert sum(len(r) for r in got.runs.values()) < 4096 * 10
    least = max(-(-total // 4096), sum(c for n, c in histogram.items() if n > 2048))
    assert least <= got.bins <= least * 1.005


def test_odd_rows(spark):
    texts = [(1, None), (1, ""), (2, "word " * 9000), (3, "a b c"), (None, "É " * 70), (-5, "a b c"), (3, "a b c")]
    df = spark.createDataFrame([(i, t, "s", 0, 0, 0) for i, t in texts], SCHEMA).repartition(3)
    check(bestfit.best_fit(df).collect(), texts, 4096)
    fill = check(bestfit.best_fit(df, window=64).collect(), texts, 64)
    assert len(fill) == -(-sum(fill) // 64)
    assert bestfit.best_fit(df.limit(0)).count() == 0


def test_a_third_of_one_length(spark):
    rng = np.random.default_rng(3)
    texts = [(k, " ".join(["a"] * (40 if k % 3 == 0 else int(rng.integers(0, 90))))) for k in range(600)]
    df = spark.createDataFrame([(i, t, "s", 0, 0, 0) for i, t in texts], SCHEMA).repartition(7)
    fill = check(bestfit.best_fit(df, window=64).collect(), texts, 64)
    bins = []
    for n in sorted((r.length for r in bestfit.pieces(df, window=64).collect()), reverse=True):  # first fit, longest first
        k = next((k for k, x in enumerate(bins) if x + n <= 64), len(bins))
        bins[k:] = [*([bins[k] + n] if k < len(bins) else [n]), *bins[k + 1 :]]
    assert len(fill) <= len(bins)
