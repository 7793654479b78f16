"""Known answers on hand-made rows: nulls, ties, cycles, repeats, empties, and what must be refused."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import geo, ranges
from millrace.model import Model
from millrace.operators import aggregates as agg
from millrace.operators import changes, graph, joins, setops, windows
from millrace.operators.predicates import field, portable
from millrace.queryset import MultipleObjects, NotFound, QuerySet
from millrace.sources import tiles
from millrace.streaming import outbox, refresh

PEDIGREE = [(1, None, None), (2, 1, 1), (3, 1, 2), (4, 2, 3)]


@pytest.fixture(scope="module")
def pedigree(spark):
    return spark.createDataFrame(PEDIGREE, "id int, mother_id int, father_id int").cache()


def test_walk_keeps_every_path(pedigree):
    rows = graph.full_ancestors(pedigree, "id", ["mother_id", "father_id"], 4).collect()
    short = {"mother_id": "m", "father_id": "f"}
    found = sorted(("".join(short[x] for x in r.path), r.id) for r in rows)
    assert found == sorted([("", 4), ("m", 2), ("f", 3), ("mm", 1), ("mf", 1), ("fm", 1), ("ff", 2), ("ffm", 1), ("fff", 1)])
    assert sorted((r.depth, r.id) for r in graph.full_ancestors(pedigree, "id", ["mother_id", "father_id"], 4, max_depth=10).collect()) == sorted((r.depth, r.id) for r in rows)


@pytest.mark.parametrize("depth", [None, 10])
def test_large_graphs_walk_level_by_level(pedigree, monkeypatch, depth):
    """Without the broadcast, the loop and the recursive statement give the same rows."""
    args = (pedigree, "id", ["mother_id", "father_id"])
    walked = sorted(tuple(r) for r in graph.full_ancestors(*args, 4, max_depth=depth).select("id", "depth", F.concat_ws(",", "path")).collect())
    closed = sorted(tuple(r) for r in graph.closure(*args, max_depth=depth).collect())
    monkeypatch.setattr(graph, "FEW", 0)
    assert walked == sorted(tuple(r) for r in graph.full_ancestors(*args, 4, max_depth=depth).select("id", "depth", F.concat_ws(",", "path")).collect())
    assert closed == sorted(tuple(r) for r in graph.closure(*args, max_depth=depth).collect())


def test_closure_counts_paths_and_is_idempotent(spark):
    t = spark.createDataFrame([(1, None, None), (2, 1, None), (3, 1, None), (4, 2, 3)], "id int, mother_id int, father_id int")
    c = graph.closure(t, "id", ["mother_id", "father_id"]).cache()
    assert {(r.src, r.anc): r.path_count for r in c.where("depth = 2").collect()} == {(4, 1): 2}
    assert c.where("depth = 0").count() == 4
    assert sorted(graph.upsert_closure(c, c).collect()) == sorted(c.collect())
    assert graph.closure(t, "id", ["mother_id"], roots=[]).count() == 0


@pytest.mark.parametrize("a, b, expected", [(5, 6, 0.25), (5, 1, 0.25), (5, 7, 0.125), (1, 2, 0.0)])
def test_kinship(spark, a, b, expected):
    rows = [(1, None, None), (2, None, None), (3, None, None), (5, 1, 2), (6, 1, 2), (7, 1, 3)]
    t = spark.createDataFrame(rows, "id int, mother_id int, father_id int")
    pairs = joins.Pairs(t, t, "id", "id", drop_equal=True).filter_left(F.col("id") == a).filter_right(F.col("id") == b)
    assert abs(joins.kinship(pairs, graph.closure(t, "id", ["mother_id", "father_id"])).first().kinship - expected) < 1e-9


@pytest.mark.parametrize("drop_equal", [True, False])
def test_kinship_in_tiles(spark, monkeypatch, drop_equal):
    """Blocks of a few rows, keys that repeat or are null or have no closure, and columns beside the key."""
    monkeypatch.setattr(joins, "_SIDE", 3)
    monkeypatch.setattr(joins, "_ENTRIES", 7)
    rows = [("a", None, None), ("b", None, None), ("c", None, None), ("e", "a", "b"), ("f", "a", "b"), ("g", "a", "c"), ("h", "e", "g")]
    t = spark.createDataFrame(rows, "id string, mother_id string, father_id string")
    left = spark.createDataFrame([("e", 1), ("e", 2), (None, 3), ("h", 4), ("z", 5), ("a", 6)], "id string, n int")
    pairs = joins.Pairs(left, t, "id", "id", drop_equal=drop_equal)
    closure = graph.closure(t, "id", ["mother_id", "father_id"])
    tiled = joins.kinship(pairs, closure)
    joined = joins.kinship(pairs.where(F.lit(True)), closure)  # a condition's pairs are joined
    assert set(tiled.columns) == set(joined.columns) and tiled.count() == (6 * 7 - 7 - 4 if drop_equal else 6 * 7)
    show = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert show(tiled) == show(joined)
    assert {r.kinship for r in tiled.where("l_id = 'e' AND r_id = 'f'").collect()} == {0.25}
    empty = joins.Pairs(left.where("n > 9"), t, "id", "id", drop_equal=drop_equal)
    assert joins.kinship(empty, closure).count() == 0


def test_kinship_rounds_as_spark(spark):
    values = [k / 2**10 for k in range(1, 4001, 2)] + [k / 2**11 for k in range(1, 4001, 7)] + [(k * 7919 % 100_003) / 2**34 + k for k in range(500)] + [0.0, 1e-12, 0.1234567885, 2.0**52 + 1]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert joins._half_up(np.array(values), 9).tolist() == [r[0] for r in df.select(F.round("x", 9)).collect()]


def test_filter_never_removes_the_root(spark):
    t = spark.createDataFrame([(1, None, "beta"), (2, 1, "alpha"), (3, 1, "beta"), (4, 1, "gamma"), (5, 3, "x")], "id int, parent_id int, name string")
    assert sorted(r.id for r in graph.descendants(t, "id", "parent_id", 1, keep=F.col("name") != "beta").collect()) == [1, 2, 4]


def test_walk_ends_on_a_cycle(spark):
    t = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id int, parent_id int")
    assert graph.ancestors(t, "id", "parent_id", 1).count() == 3
    with pytest.raises(ValueError, match="cycle"):
        graph.closure(t, "id", ["parent_id"])


def test_null_rules_differ(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    count = lambda c: df.where(c).count()
    assert count(field("c").neq("a")) == 1 and count(portable("c").neq("a")) == 2
    assert count(~portable("c").in_(["a"])) == 2 and QuerySet(None, df).exclude(field("c").eq("a")).count() == 1


def test_terminals(spark):
    m = Model("t", {"id": "int", "x": "string"}, "id", tenant=None)
    rows = m.objects(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, x string"))
    with pytest.raises(NotFound):
        rows.filter(id=9).fetch_one()
    with pytest.raises(MultipleObjects):
        rows.filter(x="a").fetch_one()
    assert rows.order_by("-id").first().id == 3 and rows.limit(1).count() == 3
    assert rows.none().fetch_all() == [] and not rows.none().exists() and rows.in_bulk([]) == {}
    with pytest.raises(ValueError, match="tenant"):
        Model("t", {"id": "int"}, "id", tenant="id").objects(spark.range(1))
    with pytest.raises(ValueError, match="begin with"):
        rows.distinct_on("x").order_by("id").to_df()
    with pytest.raises(ValueError, match="order"):
        rows.limit(1).selecting("id")


def test_lists_keep_nulls(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "i int, c string")
    r = df.agg(agg.array_agg(F.col("c")).alias("a"), agg.array_agg(F.col("c"), [F.col("i")], descending=True).alias("d"), agg.string_agg(F.col("c"), "-").alias("s")).first()
    assert (r.a, r.d, r.s) == (["a", "b", None], ["a", None, "b"], "a-b")
    with pytest.raises(ValueError, match="order"):
        agg.string_agg(F.col("c"), ",", distinct=True)


def test_last_value_is_the_last_peer(spark):
    df = spark.createDataFrame([(1, 1, 10), (1, 1, 20), (1, 2, 30)], "p int, k int, v int")
    w = windows.over("p", ["k"]).spec()
    assert {(r.v, r.c) for r in df.select("v", F.count("*").over(w).alias("c")).collect()} == {(10, 2), (20, 2), (30, 3)}


def test_set_operations_refuse_mismatches(spark):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([("1", "x")], "i string, s string")
    with pytest.raises(TypeError):
        setops.combine_as("union", a, b, ["i", "s"])
    with pytest.raises(ValueError):
        setops.combine_as("union", a, b.select("i"), ["i", "s"])


def test_merge_refuses_two_sources_for_a_row(spark):
    t = spark.createDataFrame([(1, 1)], "id int, v int")
    s = spark.createDataFrame([(1, 2), (1, 3)], "id int, v int")
    branch = [changes.Branch("matched", "update", {"v": F.col("s_v")})]
    with pytest.raises(Exception, match="two source rows"):
        changes.merge(t, s, {"id": "id"}, branch)[0].collect()
    assert changes.merge(t, s.limit(0), {"id": "id"}, branch)[1].first().total == 0
    with pytest.raises(ValueError, match="never reached"):
        changes.merge(t, s, {"id": "id"}, [*branch, changes.Branch("matched", "delete")])
    with pytest.raises(Exception, match="conflict key"):
        changes.insert_select(t, s, {"id": "id", "v": "v"}, conflict=["id"], do_update={"v": F.col("s_v")})[0].collect()


def test_update_stamps_changed_rows_only(spark):
    t = spark.sql("select 1 as id, 5 as v, timestamp'2020-01-01' as updated_at union all select 2, null, timestamp'2020-01-01'")
    after, hit = changes.update(t, F.col("v") > 1, {"v": F.lit(6)})
    assert [r.id for r in hit.collect()] == [1] and after.where("updated_at > timestamp'2021-01-01'").count() == 1
    assert changes.delete(t, F.col("v") > 1)[0].count() == 1


def test_empty_ranges(spark):
    df = spark.range(1).select(ranges.make(F.lit(3), F.lit(3)).alias("e"), ranges.make(F.lit(1), F.lit(None).cast("int")).alias("r"))
    r = df.select(F.col("e.empty"), ranges.contains(F.col("r"), F.col("e")).alias("c"), ranges.overlaps(F.col("r"), F.col("e")).alias("o"), ranges.contains_element(F.col("r"), F.lit(99)).alias("x")).first()
    assert tuple(r) == (True, True, False, True)


def test_hull_and_clusters(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (1, 4.0, 0.0), (1, 4.0, 4.0), (1, 0.0, 4.0), (1, 2.0, 2.0), (2, 1.0, 1.0)], "k int, x double, y double")
    hulls = {r.k: r for r in geo.convex_hull(df, "k", "x", "y").collect()}
    assert hulls[1].area_deg2 == 16 and len(hulls[1].hull) == 5 and len(hulls[2].hull) == 1
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.001, 0.0), (3, 0.002, 0.0), (4, 9.0, 9.0)], "id int, lon double, lat double")
    assert {r.id: r.cluster for r in geo.cluster_by_proximity(pts, "id", "lon", "lat", 150, 2).collect()} == {1: 1, 2: 1, 3: 1, 4: None}


def test_refresh_is_idempotent(spark):
    t = spark.createDataFrame([(1, 10, None), (2, 20, None), (3, 20, 5)], "id int, at int, gone int")
    first = refresh.tick(t, "id", "at", keep=F.col("id") != 2, deleted_at="gone")
    assert [r.id for r in first.rows.collect()] == [1] and first.mark == 20
    again = refresh.tick(t, "id", "at", last=20, tracked=spark.createDataFrame([(1,)], "id int"), deleted_at="gone")
    state = refresh.apply(first.rows, again, "id")
    assert sorted(r.id for r in state.collect()) == [1, 2] == sorted(r.id for r in refresh.apply(state, again, "id").collect())


def test_outbox_leases(spark):
    rows = [(1, "pending", None, 0), (2, "leased", 5, 4), (3, "leased", 50, 0), (4, "leased", 5, 0)]
    t = spark.createDataFrame(rows, "event_id int, state string, leased_until int, retry_count int")
    assert [r.event_id for r in outbox.claim(t, 2, 10).collect()] == [1, 2]
    assert {r.event_id: r.state for r in outbox.recover_stale(t, 10).collect()} == {1: "pending", 2: "failed", 3: "leased", 4: "pending"}


def test_lateral_limits_each_outer_row(spark):
    a = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    b = spark.createDataFrame([(1, 5), (1, 7), (1, 6), (2, None)], "a int, v int")
    got = joins.lateral(a, b, {"id": "a"}, ["-v"], 2, left=True).collect()
    assert sorted((r.id, r.r_v or 0, r.r_present) for r in got) == [(1, 6, True), (1, 7, True), (2, 0, True), (3, 0, False)]


def test_vector_tiles_are_encoded_in_slices(spark):
    """Tiles of sorted slices are those of whole groups: nulls, null keys, several kinds, shared values, large numbers."""
    rows = [(k, i * 37 % 91 - 40 + (1 << 40) * (i == 5), i % 3, None if i % 4 == 0 else float(i % 5), [None, "1", "\u00e9"][i % 3], None if i % 7 else i % 2 == 0, None if i % 2 else i % 6 - 2, i % 5 - 2) for k in ("a", "b", None) for i in range(0 if k else 20, 60)]
    names = ["f", "s", "b", "i", "j"]
    df = spark.createDataFrame(rows, "k string, x long, y int, f double, s string, b boolean, i int, j long").repartition(5)
    last = lambda r: (r[1], r[2], *[(v is None, v if v is not None else 0) for v in r[3:]])
    want = {k: tiles.tile("layer", [(r[1], r[2], dict(zip(names, r[3:], strict=True))) for r in sorted((r for r in rows if r[0] == k), key=last)]) for k in ("a", "b", None)}
    got = {r.k: bytes(r.mvt) for r in tiles.as_mvt(df, "k", "x", "y", names).collect()}
    assert got == want
    plain = tiles.as_mvt(df.where("k = 'a' AND i IS NULL"), "k", "x", "y", [])
    assert bytes(plain.first().mvt) == tiles.tile("layer", sorted((r[1], r[2], {}) for r in rows if r[0] == "a" and r[6] is None))
    assert "FlatMapGroupsInPandas" not in plain._jdf.queryExecution().executedPlan().toString()
