"""Links and components against all pairs in double precision."""

import math
from collections import Counter

import numpy as np
import pytest

from webtrawl.llm import vector_dedup

SCHEMA = "vec_id bigint, embedding array<double>, label string, key string, node string"


def brute_force(rows, near):
    def direction(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v, float)
        return a / np.linalg.norm(a / np.abs(a).max()) / np.abs(a).max()

    units = [direction(v) for _, v in rows]
    links = [[] for _ in rows]
    for i, x in enumerate(units):
        for j, y in enumerate(units):
            if i != j and x is not None and y is not None and len(x) == len(y) and x @ y >= near:
                links[i].append(j)
    found = []
    for i, (name, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            fresh = set(links[todo.pop()]) - seen
            seen |= fresh
            todo += fresh
        least = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
        found.append((name, len(links[i]), least, name == least))
    return Counter(found)


def near_copies(draw, base, count, noise):
    return [(base + noise * draw.standard_normal(len(base))).tolist() for _ in range(count)]


def found(spark, rows, near=0.95, least_block=16):
    frame = spark.createDataFrame([(i, v, "own", "own", "own") for i, v in rows], SCHEMA)
    got = vector_dedup.dedup(frame, near=near, least_block=least_block)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    return Counter(tuple(r) for r in got.collect())


@pytest.mark.parametrize("noise", [0.01, 0.03, 0.05])
def test_same_as_all_pairs(spark, noise):
    """Groups far above, about and below the threshold, over many tiles."""
    draw = np.random.default_rng(int(1000 * noise))
    vectors = [draw.standard_normal(24).tolist() for _ in range(60)]
    for k in range(5):
        centre = draw.standard_normal(24)
        vectors += near_copies(draw, centre / np.linalg.norm(centre), 30, noise * (1 + k / 4))
    vectors += vectors[:20] + [vectors[70]] * 60
    rows = list(zip(draw.permutation(len(vectors)).tolist(), vectors, strict=True))
    wanted = brute_force(rows, 0.95)
    assert max(n for _, n, _, _ in wanted) > 30
    assert found(spark, rows) == wanted


def test_chain_over_tiles(spark):
    """Vectors each like the next only are one component."""
    rows = [(900 - k, [math.cos(0.3 * k), math.sin(0.3 * k), 0.0]) for k in range(11)]
    assert found(spark, rows, least_block=2) == brute_force(rows, 0.95)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [0.0, -0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
        (8, [1.0, 0.0]), (9, [5.0, 0.0]), (9, [5.0, 0.0]), (None, [2.0, -0.0]), (None, [-1.0, 0.0]), (None, None),
        (10, [1.0, 0.0, 0.0]), (11, [1e300, 1e300]), (12, [1e-300, 1e-300]), (12, [0.0, 1.0]),
    ]
    assert found(spark, rows) == brute_force(rows, 0.95)


def test_no_vectors(spark):
    assert not found(spark, [])
    assert found(spark, [(1, None)]) == {(1, 0, 1, True): 1}


def test_bounds_hold():
    """The int8 cosine is never further from the true one than the bound."""
    draw = np.random.default_rng(1)
    for dim in (2, 64, 1024):
        unit = draw.standard_normal((200, dim)) * np.exp(draw.standard_normal((200, 1)))
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        q, scale, error = vector_dedup.quantised(unit)
        f = q.astype(np.float32)
        near = vector_dedup._product(f, f) * scale[:, None] * scale[None, :]
        bound = error[:, None] + error[None, :] + 3 * error[:, None] * error[None, :] + vector_dedup.SLACK
        assert (np.abs(near - unit @ unit.T) <= bound).all()


def test_many_dimensions(spark):
    draw = np.random.default_rng(2)
    base = draw.standard_normal(1500)
    rows = list(enumerate(near_copies(draw, base, 20, 0.2) + near_copies(draw, base, 20, 0.23)))
    assert found(spark, rows, least_block=8) == brute_force(rows, 0.95)


def test_tiles_that_cannot_hold_a_link_are_left_out(spark):
    """Blocks of two directions at right angles never meet."""
    draw = np.random.default_rng(4)
    rows = []
    for axis in range(4):
        rows += near_copies(draw, 10.0 * np.eye(4)[axis], 50, 0.1)
    frame = spark.createDataFrame([(k, v, "", "", "") for k, v in enumerate(rows)], SCHEMA)
    slim = frame.selectExpr("vec_id AS id", "embedding AS vector", "struct(vec_id AS a, 0L AS b) AS key")
    vectors = vector_dedup.distinct_vectors(slim)
    nodes = vector_dedup.blocks_of(vectors, 10)
    blocks = nodes.select("block", "node", "many", "vector").groupBy("block").applyInArrow(
        vector_dedup._block, vector_dedup.BLOCKS_DDL
    )
    count = blocks.count()
    assert vector_dedup.tiles(blocks, 0.95).count() < count * (count + 1) / 2
