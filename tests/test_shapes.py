import json

import pytest

from lodestrata.operators import shapes

SQUARE = [[0, 0], [1, 0], [2, 0], [2, 2], [0, 2], [0, 0]]


def test_rings_stay_closed_and_small_ones_go(spark):
    rows = [(1, "Polygon", [SQUARE, [[0, 0], [0.0001, 0], [0, 0.0001], [0, 0]]]), (2, "MultiPolygon", [[SQUARE], [SQUARE[::-1]]]), (3, "LineString", [[0, 0], [1, 0.001], [2, 0]]), (4, "MultiLineString", [[[0, 0], [0.0001, 0]], [[5, 5], [6, 6]]]), (5, "Point", [1, 2]), (6, "Polygon", []), (7, "Polygon", [[]])]
    made = spark.createDataFrame([(i, s, json.dumps(c)) for i, s, c in rows], "id long, shape string, coordinates string")
    got = {(r["id"], r["part"]): (r["kind"], r["points"]) for r in shapes.simplified_shapes(made, 0.01).collect()}
    corners = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    assert got == {(1, 0): ("ring", corners), (2, 0): ("ring", corners), (2, 1): ("ring", corners[::-1]), (3, 0): ("line", [[0, 0], [2, 0]]), (4, 0): ("line", [[5, 5], [6, 6]])}
    boxes = {r["id"]: tuple(r)[1:] for r in shapes.boxes(shapes.simplified_shapes(made, 0.01)).collect()}
    assert boxes[2] == (2, 10, 0, 0, 2, 2) and boxes[4] == (1, 2, 5, 5, 6, 6)


@pytest.mark.parametrize("tolerance", [0, -1])
def test_without_a_tolerance_only_rounding_and_repeats(tolerance):
    assert shapes.cleaned([[0, 0, 9], [0.00001, 0, 9], [1, 1, 9], [1, 1, 9]], tolerance, 3) == [[0, 0], [1, 1]]
