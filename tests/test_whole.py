"""Queries and operators do the whole job: small fixtures against brute force."""

from __future__ import annotations

import random
import re
from collections import deque

import duckdb
import oracle
from inkspan.operators import audit, extract, graph
from inkspan.plans import catalogue
from pyspark.sql import functions as F


def reached(edges: set[tuple], start) -> dict:
    """Steps over directed edges from start to each node it reaches; start itself only by a cycle."""
    out, todo = {}, deque([(start, 0)])
    while todo:
        node, k = todo.popleft()
        for a, b in edges:
            if a == node and b not in out:
                out[b] = k + 1
                todo.append((b, k + 1))
    return out


def on_cycles(edges: set[tuple]) -> set:
    return {a for a, _ in edges if a in reached(edges, a)}


def landed(spark, tmp_path, **tables) -> str:
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_genealogy_takes_all_customers(spark, tmp_path):
    rows = [(1, 2), (2, 3), (3, 1), (4, 1), (30, 5), (97, 7)]  # keys count modulo 25
    d = landed(spark, tmp_path, customer=(rows, "c_custkey long, c_nationkey int"))
    got = {r["a"] for r in catalogue.queries()["genealogy_cycles"](spark, d).collect()}
    assert got == on_cycles({(n, k % 25) for k, n in rows}) == {1, 2, 3, 5}


def test_khop_takes_all_lineitems(spark, tmp_path):
    rows = [(1, 10, 2, 5.0), (1, 10, 1, 50.0), (2, 10, 3, 46.0), (2, 11, 7, 1.0), (3, 11, 1, 2.0), (3, 12, 1, 50.0), (4, 13, 1, 50.0)]
    d = landed(spark, tmp_path, lineitem=(rows, "l_suppkey long, l_partkey long, l_linenumber int, l_quantity double"))
    got = {r["node"]: r["degree"] for r in catalogue.queries()["graph_khop"](spark, d).collect()}
    both = {e for s, p, *_ in rows for e in ((s, -p), (-p, s))}
    assert got == {n: k for n, k in (reached(both, 1) | {1: 0}).items() if k <= 3} == {1: 0, -10: 1, 2: 2, -11: 3}


def test_cycles_of_any_length(spark):
    ring = {(k, (k + 1) % 20) for k in range(20)} | {(k, 100 + (k - 99) % 9) for k in range(100, 109)}
    edges = ring | {(5, 50), (50, 51), (51, 52), (60, 0), (70, 70)}
    df = spark.createDataFrame(sorted(edges) * 2, "a long, b long")
    got = [r["a"] for r in graph.cyclic(df).collect()]
    assert sorted(got) == sorted(on_cycles(edges)) == [*range(20), 70, *range(100, 109)]
    assert graph.cyclic(df.limit(0)).count() == 0


LINES = [(1, 1, 10, 5, "A", "F"), (1, 2, 11, 5, "N", "O"), (1, 3, 12, 6, "N", "F"), (1, 7, 12, 7, "R", "O"), (2, 1, 12, 6, "R", "O"), (2, 4, 13, 8, "A", "F"), (3, 5, 13, 8, "N", "F")]
LINE = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string"


def test_relations_of_all_lines(spark, tmp_path):
    d = landed(spark, tmp_path, lineitem=(LINES, LINE))
    got = {(r["a"], r["b"], r["rel"]): (r["source"], r["evidence_uid"]) for r in catalogue.queries()["relations_apply"](spark, d).collect()}
    want = {}
    for order, line, part, supp, flag, status in LINES:
        source = {"A": "manual", "N": "ai"}.get(flag, "other")
        was = want.get(key := (supp, part, "friend" if line == 1 else "rival"), ("", None))
        want[key] = (max(source, was[0]), was[1] if was[1] or status == "O" else str(order))
    assert got == want and len(got) == 6 and got[8, 13, "rival"] == ("manual", "2")


def test_evidence_of_all_lines(spark, tmp_path):
    orders = [(1, "F"), (2, "O"), (3, "F")]
    d = landed(spark, tmp_path, lineitem=(LINES, LINE), orders=(orders, "o_orderkey long, o_orderstatus string"), part=([(p,) for p in (10, 11, 12, 13, 14)], "p_partkey long"))
    got = {r["rel_id"]: (r["evidence_count"], r["state"]) for r in catalogue.queries()["evidence_state"](spark, d).collect()}
    alive = {p: {o for o, _, q, *_ in LINES if q == p} for p in (10, 11, 12, 13, 14)}
    own = {10: "none"}  # the fifth parts have no main evidence; no order has the others' key
    assert got == {p: (len(o), "active" if 2 in o else own.get(p, "missing")) for p, o in alive.items()} and got[13] == (2, "active")


def test_evidence_union_and_lineage_of_all_lines(spark, tmp_path):
    d = landed(spark, tmp_path, lineitem=(LINES, LINE))
    got = [(r["rel_id"], r["uid"]) for r in catalogue.queries()["evidence_union"](spark, d).collect()]
    assert sorted(got) == sorted({(p, s) for _, _, p, s, *_ in LINES})
    near = sorted((tuple(r) for r in catalogue.queries()["lineage_neighbours"](spark, d).collect()), key=lambda r: r[:2])
    assert near == [(1, 1, None, 11), (1, 2, 10, 12), (1, 3, 11, 12), (1, 7, 12, None), (2, 1, None, 13), (2, 4, 12, None), (3, 5, None, None)]


def test_notes_go_at_any_depth(spark):
    def plain(text):
        while (less := re.sub("〈[^〈〉]*〉", "", text)) != text:
            text = less
        return text

    deal = random.Random(1)
    texts = ["a" + "〈b" * 9 + "〉" * 9 + "c", "a" + "〈b" * 7 + "〉" * 5 + "c", "〉" * 6 + "a〈", "", "x\ny"] + ["".join(deal.choices("a〈〉", k=60)) for _ in range(300)]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], ["s"]).select(extract.without_notes(F.col("s"))).collect()]
    assert got == [plain(t) for t in texts] and got[0] == "ac"
    assert spark.createDataFrame([(None,)], "s string").select(extract.without_notes(F.col("s"))).first()[0] is None


def test_titles_are_not_broadcast(spark, tmp_path, monkeypatch):
    names = ["AUTO", "GREEN AU", "", None, "GREE", "AUAU"] * 5
    d = landed(spark, tmp_path, chapters=(list(enumerate(names)), "k long, title string"))
    chapters = spark.read.parquet(f"{d}/chapters.parquet")
    places = spark.createDataFrame([("l1", ["GREEN", "GREEN"]), ("l2", ["AU", "", None]), ("l3", ["UA", "AU"]), (None, ["TO"])], "id string, aliases array<string>")
    pairs = {(i, a) for i, aliases in (("l1", ["GREEN"]), ("l2", ["AU"]), ("l3", ["UA", "AU"]), (None, ["TO"])) for a in aliases}
    want = sorted((k, str(i), a) for k, t in enumerate(names) for i, a in pairs if t and a in t)
    for limit, join in ((audit.BROADCAST, "BuildRight"), (0, "SortMergeJoin")):  # few aliases, then too many to be broadcast
        monkeypatch.setattr(audit, "BROADCAST", limit)
        found = audit.titles_with(places, chapters)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert join in plan and "BuildLeft" not in plan
        assert sorted((r["k"], str(r["id"]), r["alias"]) for r in found.collect()) == want


def test_page_titles_are_those_of_its_sql(spark, tmp_path):
    titles = ["56.187.231.175 Keit in", "4501042323994846 Anth", "12. a", "一、本紀", "", "  a b ", "\u3000\xa0a\u2003", "\ta\n", "\xa0\n \x85", "\u3000", "a\u200b\ufeff ", " 7 ", "a\r\nb \n", "\U00024cf9 "]
    pages = [f"<html><TITLE>{t}</Title><title>x</title>" for t in titles] + [None, "", "<title>open", "<title a='b'>c</title>", "</title><title>1. d</title>"]
    d = landed(spark, tmp_path, pages=(list(enumerate(pages)), "page_id long, html string"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet/*.parquet'")
    assert oracle.same(spark, con, d, catalogue.queries()["page_titles"], catalogue.oracle_sql()["page_titles"]) == ""
    got = [r["title"] for r in catalogue.queries()["page_titles"](spark, d).orderBy("page_id").collect()]
    assert got[:4] == titles[:4] and got[6] == "a" and got[-5:] == [None, "", "", "", "1. d"]
