import random
import re

import numpy as np
import pyarrow as pa

from docquarry.llm.tokens import Words, grams, runs, slices, span_hashes, string_buffers

TEXTS = ["Hello, World! hello", None, "", "  ", "Été à l'école", "x", "a-b_c d.e", "ÀÉ É", "1 22 333", "hello"]
WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")


def test_words_are_those_of_the_pattern():
    words = Words(pa.array(TEXTS))
    for i, text in enumerate(TEXTS):
        got = [words.data[a:b].tobytes().decode() for a, b in zip(words.starts[words.row[i] : words.row[i + 1]], words.ends[words.row[i] : words.row[i + 1]], strict=True)]
        assert got == WORD.findall((text or "").lower())


def test_equal_words_have_equal_hashes_wherever_they_stand():
    rng = random.Random(1)
    names = [f"w{rng.randrange(300)}" for _ in range(5000)]
    words = Words(pa.array([" ".join(names), "zz " + " ".join(reversed(names))]))
    by = {}
    for h, a, b in zip(words.hashes.tolist(), words.starts, words.ends, strict=True):
        by.setdefault(words.data[a:b].tobytes(), set()).add(h)
    assert all(len(v) == 1 for v in by.values())
    assert len({next(iter(v)) for v in by.values()}) == len(by)


def test_sliced_arrays_and_slices_of_whole_rows():
    texts = pa.array(["aa bb"] * 50 + ["x " * 5000] + [None, "cc"])
    assert [Words(texts.slice(50, 3)).row.tolist()[-1]] == [5001]
    parts = list(slices(texts, 100))
    assert [a for a, _ in parts][0] == 0 and parts[-1][1] == len(texts)
    assert all(x[1] == y[0] for x, y in zip(parts, parts[1:], strict=False))


def test_grams_stay_inside_rows_and_short_rows_have_one():
    words = Words(pa.array(["a b c d", "a b", "", "c d e"]))
    hashes, at = grams(words.hashes, words.row, 3)
    per_row = np.diff(np.searchsorted(at, words.row))
    assert per_row.tolist() == [2, 1, 0, 1]
    again, _ = grams(*(lambda w: (w.hashes, w.row))(Words(pa.array(["x", "c d e"]))), 3)
    assert hashes[-1] == again[-1]


def test_empty_inputs():
    assert len(Words(pa.array([], pa.string())).hashes) == 0
    data, offsets = string_buffers(pa.array([None, None], pa.string()))
    assert len(data) == 0 and offsets.tolist() == [0, 0, 0]
    starts, ends = runs(np.zeros(0, bool), np.array([0, 0]))
    assert len(span_hashes(data, starts, ends)) == 0
