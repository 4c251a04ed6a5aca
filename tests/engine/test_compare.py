from collections import Counter

from gradeloom.operators.compare import differences

ROW = "k int, meta struct<a:int,b:struct<c:string,d:double>>, list array<struct<x:int,y:array<int>>>, map map<string,struct<v:int>>"


def found(spark, old, new, *keys):
    a, b = (spark.createDataFrame(x, ROW) for x in (old, new))
    return Counter(tuple(r) for r in differences(a, b.select(*reversed(b.columns)), *(keys or ("k",))).collect())


BASE = (1, (1, ("u", 0.5)), [(1, [1, 2]), (2, None)], {"p": (1,), "q": (None,)})


def test_leaves(spark):
    new = (1, (2, ("u", None)), [(1, [1, 3, 4]), (2, [])], {"p": (5,), "r": (None,)})
    assert found(spark, [BASE], [new]) == Counter([
        (1, "meta.a", "changed", "1", "2"), (1, "meta.b.d", "changed", "0.5", None), (1, "list[0].y[1]", "changed", "2", "3"), (1, "list[0].y[2]", "added", None, "4"),
        (1, "list[1].y", "changed", None, "[]"), (1, "map[p].v", "changed", "1", "5"), (1, "map[q]", "lost", '{"v":null}', None), (1, "map[r]", "added", None, '{"v":null}'),
    ])


def test_equal_nulls_and_missing_rows(spark):
    none = (2, None, None, None)
    assert not found(spark, [BASE, none], [none, BASE])
    assert not found(spark, [], [])
    got = found(spark, [none, (None, None, [], {})], [(2, (None, None), [], None), (None, None, [], {}), (3, None, None, None)])
    assert got == Counter([(2, "meta", "changed", None, '{"a":null,"b":null}'), (2, "list", "changed", None, "[]"), (3, "", "added", None, '{"meta":null,"list":null,"map":null}')])
    assert [k[1:3] for k in found(spark, [BASE], [])] == [("", "lost")]


def test_order_of_entries_and_copies(spark):
    turned = (*BASE[:3], {"q": (None,), "p": (1,)})
    assert not found(spark, [BASE], [turned])
    other = (1, None, BASE[2], BASE[3])
    assert found(spark, [BASE, BASE], [BASE, other]) == Counter([(1, "meta", "changed", '{"a":1,"b":{"c":"u","d":0.5}}', None)])
    assert sum(found(spark, [BASE] * 3, [BASE]).values()) == 2  # copies that are gone
