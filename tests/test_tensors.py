"""Detector tensors: layout, letterbox, output decoding in both orientations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidereel.functions import media, tensors


def test_layout_of_an_input():
    assert tensors.input_layout([1, 3, 320, 416]) == (True, 320, 416)
    assert tensors.input_layout([-1, 480, -1, 3]) == (False, 480, 640)
    assert tensors.input_layout([1, 3, -1, 0]) == (True, 640, 640)
    for bad in ([1, 3, 640], [1, 4, 640, 640]):
        with pytest.raises(ValueError):
            tensors.input_layout(bad)


@pytest.mark.parametrize("h, w, height, width", [(4, 8, 10, 10), (9, 3, 6, 12), (5, 5, 5, 5), (30, 50, 7, 7), (1, 100, 8, 8)])
def test_letterbox_pixel_by_pixel(h, w, height, width):
    frame = np.random.default_rng(h).integers(0, 256, (h, w, 3), dtype=np.uint8)
    scale = min(width / w, height / h)
    tall, wide = max(int(h * scale + 0.5), 1), max(int(w * scale + 0.5), 1)
    want = np.full((height, width, 3), 114 / 255)
    for y in range(tall):
        for x in range(wide):
            b, g, r = frame[min(int(y / scale + 1e-6), h - 1), min(int(x / scale + 1e-6), w - 1)]
            want[y + (height - tall) // 2, x + (width - wide) // 2] = r / 255, g / 255, b / 255
    got = tensors.letterbox(frame, height, width, channels_first=False)
    assert got.dtype == np.float32 and np.allclose(got, want, atol=1e-6)
    assert np.array_equal(tensors.letterbox(frame, height, width), got.transpose(2, 0, 1))


def plain(m):
    """The rule on a list of rows, item by item."""
    rows, columns = len(m), len(m[0]) if m else 0
    lying = rows < columns if min(rows, columns) >= 5 else rows >= 5
    n, items = (rows, columns) if lying else (columns, rows)
    if n < 5:
        return None
    cell = (lambda a, i: m[a][i]) if lying else (lambda a, i: m[i][a])
    return max([0.0, *(cell(4, i) * cell(5, i) if n == 6 or n >= 85 else cell(4, i) for i in range(items))])


def test_outputs_of_all_shapes(spark):
    rng = np.random.default_rng(1)
    shapes = [(2, 5), (2, 6), (5, 5), (6, 5), (5, 6), (6, 6), (84, 100), (100, 84), (85, 3), (3, 85), (4, 4), (1, 4), (7, 90), (90, 7), (5, 2), (4, 6)]
    data = [np.round(rng.normal(0.2, 0.5, s), 3) for s in shapes] + [np.full((3, 5), -1.0)]
    rows = [(k, m.tolist()) for k, m in enumerate(data)] + [(99, [])]
    got = {r.k: r.p for r in spark.createDataFrame(rows, "k int, m array<array<double>>").select("k", media.person_score(F.col("m")).alias("p")).collect()}
    for k, m in rows:
        want = plain(m)
        assert got[k] is None if want is None else abs(got[k] - want) < 1e-12
        if m:
            own = tensors.person_score(np.array(m))
            assert own is None if want is None else abs(own - want) < 1e-9
    two = np.stack([data[0], data[0] + 5])
    assert tensors.person_score(two) == tensors.person_score(data[0])  # the first of a batch only
    assert tensors.person_score(np.zeros((0, 6, 6))) is None and tensors.person_score(np.zeros(6)) is None and tensors.person_score(np.zeros((1, 1, 6, 6))) is None
    assert abs(tensors.person_score(np.array([[0, 0, 0, 0, 0.3], [0, 0, 0, 0, 0.9]])) - 0.9) < 1e-6


def test_distinct_lines(spark):
    text = " one \n\ntwo\r\none\n  \nthree"
    assert tensors.distinct_lines(text) == ["one", "two", "three"] == spark.createDataFrame([(text,)], "t string").select(media.distinct_lines(F.col("t"))).first()[0]
