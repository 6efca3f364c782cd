"""Connected components of chains, stars and empty edge lists."""

from evalsmith.operators.graph import components


def test_components_of_chains_and_stars(spark):
    edges = [(i + 1, i) for i in range(300)] + [(1000, 2000 + i) for i in range(200)] + [(5000, 5000)]
    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(roots[i] == 0 for i in range(1, 301))
    assert all(roots[2000 + i] == 1000 for i in range(200))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
