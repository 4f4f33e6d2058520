"""Bounds on what a task holds, as multiples of its input."""

import tracemalloc

import numpy as np

from panelspark.llm import suffix_dedup


def peak(run, *args):
    tracemalloc.start()
    try:
        out = run(*args)
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_suffix_arrays_hold_few_bytes_a_byte():
    rnd = np.random.Generator(np.random.PCG64(1))
    raw = rnd.integers(97, 123, 300_000).astype(np.uint8).tobytes()
    strings = [raw[i : i + 1500] for i in range(0, len(raw) - 1500, 1000)]
    suffix_dedup.repeated_in(strings[:2], [1, 1])
    found, most = peak(suffix_dedup.repeated_in, strings, [1] * len(strings))
    # neighbouring strings share 500 bytes, so 301 windows at either end
    assert [len(f) for f in found] == [301, *[602] * (len(strings) - 2), 301]
    assert most < 60 * sum(map(len, strings))


def test_long_strings_of_one_name_are_counted_by_content(spark, monkeypatch):
    """Few strings of many bytes fill a task as many strings do."""
    seen = []
    whole = suffix_dedup.repeats_by_counts
    monkeypatch.setattr(suffix_dedup, "repeats_by_counts", lambda strings: seen.append(1) or whole(strings))
    rows = [(1, 1, 1, b"a" * 300), (1, 2, 1, b"a" * 280 + b"b" * 40), (2, 3, 1, b"c" * 250)]
    strings = spark.createDataFrame(rows, "name bigint, string bigint, n bigint, content binary")
    windows = lambda: sorted((r["string"], i) for r in suffix_dedup.repeated_windows(strings).collect() for a in r["ranges"] for i in range(a["first"], a["last"] + 1))
    want = windows()
    assert not seen
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", 600)
    assert windows() == want and seen
