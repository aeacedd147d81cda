"""Hashes of spans, and texts as blocks."""

import numpy as np
import pyarrow as pa
import pytest

from tallyline.llm import common, neardup, quality


def flat(texts):
    return common.flat(pa.array(texts, pa.string()))


def thue_morse(length, swap):
    """A sequence whose two forms collide under any polynomial modulo a power of two."""
    return "".join("ab"[(i.bit_count() + swap) % 2] for i in range(length))


@pytest.mark.parametrize("length", [1024, 2048, 4096])
def test_words_that_polynomials_mistake_for_equal(length):
    a, b = thue_morse(length, 0), thue_morse(length, 1)
    data, at = flat([f"{a} {b} {a}"])
    starts, ends, _ = common.word_bounds(data, at)
    one, two, three = common.span_hashes(data, starts, ends)
    assert one == three != two
    data, at = flat([f"{a}\n{b}\n", f"{a}\n{a}\n"])
    assert quality.measures(data, at)["n_dup_lines"].tolist() == [0, 1]
    data, at = flat([f"{a} x y", f"{b} x y"])
    left, right = neardup.shingle_sets(data, at, 3)
    assert left.tolist() != right.tolist()


def test_hashes_depend_on_the_bytes_of_a_span_alone():
    rng = np.random.default_rng(5)
    spans = {bytes(rng.integers(97, 100, rng.integers(1, 40)).astype(np.uint8)) for _ in range(3000)}
    spans |= {b"a" * n for n in range(1, 40)} | {b"a" * n + b"\x00" for n in range(1, 40)}
    for sep in (b" ", b"zz"):
        words, seen, at = sorted(spans) * 2, {}, 0
        starts = np.cumsum([0] + [len(w) + len(sep) for w in words])[:-1]
        data = np.frombuffer(sep.join(words), np.uint8)
        hashes = common.span_hashes(data, starts, starts + np.array([len(w) for w in words]))
        for word, value in zip(words, hashes.tolist()):
            assert seen.setdefault(value, word) == word
        assert len(seen) == len(spans)


def test_blocks_are_bounded_by_rows_and_bytes():
    texts = ["tiny"] * 10_000 + [None, "", "x" * 5000]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    parts = list(common.blocks(iter([batch]), "text", limit=2000, rows=128))
    assert [t for rows, _, _ in parts for t in rows.column(0).to_pylist()] == texts
    assert max(rows.num_rows for rows, _, _ in parts) == 128
    for rows, data, at in parts:
        assert len(at) == rows.num_rows + 1 and at[0] == 0 and at[-1] == len(data)
        assert len(data) <= 2000 or rows.num_rows == 1
