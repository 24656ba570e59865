import numpy as np
import pytest
from cellspark.operators import pixels


def objects(mask):
    """Labels in reading order by plain flood fill."""
    label, n = np.zeros(mask.shape, int), 0
    for y, x in np.argwhere(mask):
        if not label[y, x]:
            n += 1
            todo = [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not label[a, b]:
                    label[a, b] = n
                    todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    return label


def spiral(n):
    m = np.zeros((n, n), bool)
    y, x, dy, dx = 0, 0, 0, 1
    m[0, 0] = True
    for _ in range(n * n):
        free = lambda a, b: 0 <= a < n and 0 <= b < n and not m[a, b] and not (0 <= a + (a - y) < n and 0 <= b + (b - x) < n and m[a + (a - y), b + (b - x)])  # noqa: B023, E731
        if not free(y + dy, x + dx):
            dy, dx = dx, -dy
            if not free(y + dy, x + dx):
                break
        y, x = y + dy, x + dx
        m[y, x] = True
    return m


def test_objects_over_tiles(spark):
    rng = np.random.default_rng(4)
    pictures = {"noise": rng.random((30, 41)) < 0.62, "thin": rng.random((17, 23)) < 0.45, "spiral": spiral(33), "full": np.ones((20, 20), bool), "none": np.zeros((5, 5), bool)}
    rows = [(k, int(y) - 9, int(x) - 3, int(v)) for k, m in pictures.items() for (y, x), v in np.ndenumerate(m)]
    df = spark.createDataFrame(rows, "image string, y int, x int, label int")
    got = {(r.image, r.y + 9, r.x + 3): r.label for r in pixels.connected_objects(df, tile=8).collect()}
    want = {(k, int(y), int(x)): int(v) for k, m in pictures.items() for (y, x), v in np.ndenumerate(objects(m)) if v}
    assert got == want and max(v for (k, *_), v in got.items() if k == "spiral") == 1


@pytest.mark.parametrize("radius, tile", [(10, 16), (40, 24), (0, 16)])
def test_growth_same_as_brute_force(spark, radius, tile):
    rng = np.random.default_rng(radius)
    rows, grid = [], []
    for image in "ab":
        seeds = np.where(rng.random((60, 75)) < 0.004, rng.integers(1, 9, (60, 75)), 0)
        there = rng.random((60, 75)) < 0.9
        rows += [(image, int(y), int(x), int(v)) for (y, x), v in np.ndenumerate(seeds)]
        grid += [(image, int(y), int(x), 1.0) for (y, x), v in np.ndenumerate(there) if v]
    rows.append(("a", 3, 3, None))
    got = {(r.image, r.y, r.x): r.label for r in pixels.expand_labels(spark.createDataFrame(rows, "image string, y int, x int, label int"), spark.createDataFrame(grid, "image string, y int, x int, v double"), radius, tile).collect()}
    want = {}
    for image in "ab":
        own = np.array([(y, x, v) for i, y, x, v in rows if i == image and v])
        for i, y, x, _ in grid:
            if i == image:
                d = (own[:, 0] - y) ** 2 + (own[:, 1] - x) ** 2
                best = min(zip(d.tolist(), own[:, 2].tolist(), strict=True))
                if best[0] <= radius * radius:
                    want[image, y, x] = best[1]
    assert got == want
