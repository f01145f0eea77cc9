"""Graph rounds as joins and as arrays in one task, against plain loops."""

import random

import pytest

from ridgeline.operators import graph


@pytest.fixture(params=[0, graph.SMALL_BYTES])
def size(request, monkeypatch):
    monkeypatch.setattr(graph, "SMALL_BYTES", request.param)


def forest(n: int) -> dict[int, int | None]:
    rng = random.Random(n)
    return {i * 3: rng.choice([None, *[j * 3 for j in range(max(0, i - 4), i)]]) if i else None for i in range(n)}


def rows(df) -> dict:
    return {r[0]: tuple(r)[1:] if len(r) > 2 else r[1] for r in df.collect()}


def test_forests(spark, size):
    up = forest(60) | {1000: 999}  # 999 is no node
    edges = spark.createDataFrame(list(up.items()), "node bigint, dst bigint")

    def path(k):
        while k in up:
            yield k
            k = up[k]

    sizes = dict.fromkeys(up, 0)
    for k in up:
        for x in path(k):
            sizes[x] += 1
    assert rows(graph.subtree_sizes(edges)) == sizes
    seeds = [0, 30, 90, 7777]
    want = {k: d for k in up if (d := next((i for i, x in enumerate(path(k)) if x in seeds), None)) is not None}
    assert rows(graph.reaches(edges, spark.createDataFrame([(s,) for s in seeds], "node bigint"))) == want
    rooted = {k: v for k, v in up.items() if k < 1000}
    assert rows(graph.chains(spark.createDataFrame(list(rooted.items()), "node bigint, up bigint"))) == {k: len(list(path(k))) - 1 for k in rooted}


@pytest.mark.parametrize("text", [False, True])
def test_components(spark, size, text):
    rng = random.Random(3)
    name = (lambda k: f"{'é' if k % 2 else 'z'}{k}") if text else (lambda k: k)
    links = [(name(rng.randrange(80)), name(rng.randrange(80))) for _ in range(55)] + [(name(5), name(5)), (name(90), name(90))]
    kind = "string" if text else "bigint"
    order = (lambda x: x.encode()) if text else (lambda x: x)
    label = {x: x for e in links for x in e}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b], key=order)
    df = spark.createDataFrame(links, f"a {kind}, b {kind}")
    ends = {x for a, b in links if a != b for x in (a, b)}
    assert rows(graph.connected(df)) == {k: v for k, v in label.items() if k in ends}
    nodes = spark.createDataFrame([(x,) for x in label] + [(name(500),)], f"node {kind}")
    assert rows(graph.components(df, nodes)) == label | {name(500): name(500)}


def test_cycles(spark, size):
    rng = random.Random(9)
    nodes = rng.sample(range(10**6), 100)
    rings = [nodes[:1], nodes[1:3], nodes[3:10], nodes[10:42], nodes[42:]]
    links = [(a, b) for r in rings for a, b in zip(r, r[1:] + r[:1], strict=True)]
    want = {}
    for r in rings:
        at = r.index(min(r))
        want |= {x: (min(r), k) for k, x in enumerate(r[at:] + r[:at])}
    assert rows(graph.cycles(spark.createDataFrame(links, "node bigint, next bigint"))) == want


def test_nothing(spark, size):
    none = spark.createDataFrame([], "a bigint, b bigint")
    assert graph.connected(none).count() == graph.cycles(none.toDF("node", "next")).count() == graph.chains(none.toDF("node", "up")).count() == 0
    assert graph.subtree_sizes(none.toDF("node", "dst")).count() == graph.reaches(none.toDF("node", "dst"), none.select("a").toDF("node")).count() == 0


def test_rounds_send_no_table_to_the_driver(spark, monkeypatch):
    """Each broadcast of a round's table passes through the driver, and rounds are many."""
    from pyspark.sql import functions as F

    joins, write = [], graph.written

    def watched(df, name):
        joins.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(graph, "SMALL_BYTES", 0)
    monkeypatch.setattr(graph, "written", watched)
    n = spark.range(200)
    forest = n.select(F.col("id").alias("node"), F.nullif(F.floor(F.col("id") / 2), "id").alias("dst"))
    assert graph.subtree_sizes(forest).where("node = 0").first().size == 200
    assert graph.reaches(forest, n.where("id = 0").withColumnRenamed("id", "node")).count() == 200
    assert graph.connected(n.select(F.col("id").alias("a"), F.floor(F.col("id") / 2).alias("b"))).where("label = 0").count() == 200
    assert graph.cycles(n.select(F.col("id").alias("node"), ((F.col("id") + 1) % 200).alias("next"))).agg(F.max("rank").alias("m")).first().m == 199
    assert graph.chains(forest.withColumnRenamed("dst", "up")).agg(F.max("depth").alias("m")).first().m == 8
    assert len(joins) > 20 and not [p for p in joins if "Broadcast" in p]


def test_rings_and_inflow_send_no_table_to_the_driver(spark, monkeypatch):
    """Tables of the raster's or the rings' size are joined by shuffles; what a total of one row needs may be broadcast."""
    from pyspark.sql import functions as F
    from ridgeline.functions.grid import Grid
    from ridgeline.operators import flood, outlines, regions, terrain

    grid = Grid(20, 20, 0.0, 0.0, 1.0, 1.0)
    dem = spark.range(400).select(F.floor(F.col("id") / 20).cast("int").alias("r"), (F.col("id") % 20).cast("int").alias("c"), (F.col("id") * 37 % 101).cast("double").alias("elev"))
    seen, write = [], outlines.written

    def watched(df, name):
        seen.append(df)
        return write(df, name)

    for module in (outlines, regions, graph, terrain, flood):
        monkeypatch.setattr(module, "written", watched)
    nested = outlines.nested(outlines.ringed(regions.labelled_runs(dem.where("elev < 60"), grid), grid))
    flow = watched(terrain.d8_flow(dem), "flow")
    main = dem.where("c = 3").select("r", "c")
    caught = terrain.catchment(dem, flow, main, grid)
    plan = terrain.inflow_plan(terrain.accumulation(dem, flow, grid), caught, main, dem.select("r", "c"), grid, 2.0)
    box = flood.boxes(plan.withColumn("scenario", F.lit(0)), flow, grid)
    assert nested.count() and plan.count() and box.count() == 1
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (*seen, nested, terrain.flux_box(main, flow, grid), caught)]
    assert not [p for p in plans if "BroadcastHashJoin" in p]
    assert "BroadcastHashJoin" not in plan._jdf.queryExecution().executedPlan().toString()
