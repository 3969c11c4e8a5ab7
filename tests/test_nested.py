"""Nested entries: every odd case has a defined result."""

import datetime as dt
import json

from lexichron.operators import nested

TYPED = """entry_id bigint, eid string, `dc:title` string, `dc:creator` string, `author-count` struct<`@total`: string>,
    author array<struct<`@seq`: string, authname: string, afid: array<struct<`$`: string>>>>,
    affiliation array<struct<afid: string, affilname: string, `affiliation-city`: string, `affiliation-country`: string>>,
    harvested_at timestamp, author_pos string"""
T0, T1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)


def affil(i, n="n"):
    return (i, n, None, None)


def author(*ids, name="x"):
    return ("1", name, None if ids == (None,) else [(i,) for i in ids])


def typed(spark, rows):
    return spark.createDataFrame([(i, "e", "t", "c", ("2",), a, f, at, "clash") for i, a, f, at in rows], TYPED)


def raw(spark, rows):
    return spark.createDataFrame(rows, "entry_id bigint, payload string, harvested_at timestamp, a string")


def links(df, **more):
    return sorted(tuple(r) for r in nested.link_table(df, **more).collect())


def test_links_positions_repeats_nulls_and_latest(spark):
    rows = [
        (1, [author("b", "a", "a"), None, author("z"), author(None)], [affil("a"), None, affil("b"), affil("a"), affil(None)], T0),
        (2, [author("a")], [affil("a")], T0),
        (2, [author("a"), author("a")], [affil("q"), affil("a")], T1),
        (2, [author("a"), author("a")], [affil("q"), affil("a")], T1),
        (3, None, [affil("a")], T0),
        (4, [], None, None),
        (5, [author("a")], None, None),
        (5, [author("a"), author("b")], None, T0),
    ]
    got = nested.canonical(typed(spark, rows), None)
    assert links(got, keep_unlinked=True) == [(1, 1, 1), (1, 1, 3), (1, 3, 0), (1, 4, 0), (2, 1, 2), (2, 2, 2), (5, 1, 0), (5, 2, 0)]
    assert links(got) == [(1, 1, 1), (1, 1, 3), (2, 1, 2), (2, 2, 2)]
    assert nested.author_table(got).filter("entry_id = 1").count() == 3
    assert [r.affil_pos for r in nested.affiliation_table(got).filter("entry_id = 1").orderBy("affil_pos").collect()] == [1, 3, 4, 5]
    assert {r.entry_id: r.n_authors for r in nested.entry_table(got).collect()} == {1: 3, 2: 2, 3: 0, 4: 0, 5: 2}


def test_raw_shapes(spark):
    one = {"author": {"authname": "x", "afid": "7"}, "affiliation": {"afid": "7"}, "author-count": 1}
    many = {"author": [None, {"afid": [{"$": "7"}, "8", None]}, {"authname": "n"}], "affiliation": [{"afid": "8"}, None, {"afid": "7"}], "author-count": {"@total": "3"}}
    payloads = [
        (1, json.dumps(one)),
        (2, json.dumps({"entry": [many]})),
        (3, json.dumps({"search-results": {"entry": [one]}})),
        (4, json.dumps({"entry": one})),
        (5, '{"entry": {"author": ['),
        (6, None),
        (7, ""),
        (8, "[]"),
        (9, json.dumps({"author": None, "affiliation": []})),
        (10, "3"),
        (11, json.dumps(one) + " and more"),
    ]
    got = nested.canonical(None, raw(spark, [(i, p, T0, "clash") for i, p in payloads]))
    assert links(got, keep_unlinked=True) == [(1, 1, 1), (2, 2, 1), (2, 2, 3), (2, 3, 0), (3, 1, 1), (4, 1, 1)]
    declared = {r.entry_id: r.declared_authors for r in nested.entry_table(got).collect()}
    assert declared[1] == 1 and declared[2] == 3 and declared[9] is None


def test_empty_tables(spark):
    got = nested.canonical(typed(spark, []), raw(spark, []))
    assert all(t.count() == 0 for t in nested.flatten(got).values())


def test_long_list(spark):
    ids = [str(i) for i in range(3000)]
    got = nested.canonical(typed(spark, [(1, [author(*ids)], [affil(i) for i in reversed(ids)], T0)]), None)
    assert len(links(got)) == 3000
