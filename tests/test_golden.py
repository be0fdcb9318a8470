"""Small fixtures for what SQL does not say: spans, ladders, HTML, notes, edits, sources, sinks and streams."""

from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from inkspan.functions import text as t
from inkspan.operators import annotate, extract, index, versions
from inkspan.plans import model as m
from inkspan.sources import readers, sinks
from inkspan.streaming import incremental
from pyspark.sql import functions as F


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first()["x"]


def test_spans_are_code_points(spark):
    x = one(spark, annotate.spans_in(F.col("s"), {"高祖": "p1"}), s="a\U00024cf9高祖、高祖")
    assert [(r["s"], r["e"], r["surface"]) for r in x] == [(2, 4, "高祖"), (5, 7, "高祖")]


def test_longest_alias_wins_and_greatest_owner():
    assert m.alternation(["ab", "a", "abc"]) == "abc|ab|a"
    assert m.surfaces([("p1", ["x"]), ("p2", ["x"])]) == {"x": "p2"}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from("ab高\U0001f600. "), max_size=30).map("".join))
def test_span_contract(spark, s):
    x = one(spark, annotate.spans_in(F.col("s"), {"ab": "1", "a": "2", "高": "3"}), s=s)
    assert all(s[r["s"] : r["e"]] == r["surface"] for r in x)
    assert all(a["e"] <= b["s"] for a, b in zip(x, x[1:]))


def test_guards_and_additions(spark):
    base = annotate.spans_in(F.col("s"), {"王": "p1"})
    assert [r["s"] for r in one(spark, annotate.guarded(base, F.col("s"), before={"王": "大"}, after={"王": "后"}), s="王大王王后")] == [0]
    got = one(spark, annotate.added(annotate.spans_in(F.col("s"), {"ab": "1"}), annotate.spans_in(F.col("s"), {"b": "2"}), whole=True), s="abb")
    assert [(r["s"], r["id"]) for r in got] == [(0, "1"), (2, "2")]


def test_place_guards(spark):
    people = annotate.spans_in(F.col("s"), {"秦王政": "p1", "秦文王": "p2"})
    place = lambda **k: annotate.place_spans(F.col("s"), {"秦": "l1", "河内": "l2"}, people, **k)
    at = lambda s, **k: [r["s"] for r in one(spark, place(**k), s=s)]
    assert at("秦王政入秦") == [4]
    assert at("秦文王在秦") == [0, 4]  # a place, a posthumous character and a rank
    assert at("秦河内", off=("秦",)) == [1]
    assert at("大秦國秦", longer=("大秦國",)) == [3]


ERAS = ("夏", "商", "周", "秦", "漢", "晉")
ERA_OF = {"a": "周", "b": "秦", "c": "晉"}


@pytest.mark.parametrize(
    "title,ev,want",
    [
        (dict(rules=(("post", "景元", "b"),)), dict(text="元帝景元", span=(0, 2)), ("b", "sentence")),
        (dict(rules=(("sent", "景元", None),)), dict(text="元帝景元", span=(0, 2)), (None, "none")),
        (dict(by_book={"x": ("b",)}), dict(book="x"), ("b", "era")),
        (dict(by_book={"x": ("b",)}), dict(book="y"), (None, "none")),
        (dict(), dict(book="y", scope={"a": {"x"}, "c": {"x"}}), ("b", "era")),
        (dict(), dict(owners={"a"}), ("a", "owner")),
        (dict(), dict(owners={"a", "b"}, related={"c"}), ("c", "related")),
        (dict(), dict(sentence={"b": 1}), ("b", "sentence")),
        (dict(), dict(sentence={"a": 1, "b": 1}, paragraph={"a": 2, "b": 1}), ("a", "paragraph")),
        (dict(), dict(chapter={"c": 2}), ("c", "chapter")),
        (dict(), dict(chapter={"c": 1}), ("a", "guess")),
        (dict(), dict(era="秦"), ("b", "era")),
        (dict(candidates=("a", "c"), default="a"), dict(era="晉"), ("c", "era")),
        (dict(candidates=("a", "b"), default="a"), dict(era="漢"), ("a", "guess")),
        (dict(candidates=("a",), default="a"), dict(era="夏"), (None, "none")),
        (dict(default=None), dict(), (None, "none")),
    ],
)
def test_ladder(title, ev, want):
    ev = dict(ev)
    scope = ev.pop("scope", {})
    from collections import Counter

    for k in ("sentence", "paragraph", "chapter"):
        if k in ev:
            ev[k] = Counter(ev[k])
    t_ = annotate.Title(**{"alias": "王", "candidates": ("a", "b", "c"), "default": "a", **title})
    assert annotate.attribute(t_, annotate.Evidence(**ev), ERAS, ERA_OF, scope) == want


def test_ladder_through_spark(spark):
    """Every tier, over chapters of which owners, related persons and eras are known."""
    sents = spark.createDataFrame([(k, "b", 1, 1, f"u{k}", t) for k, t in enumerate(["王", "王", "甲王", "王", "王", "王言", "王", "乙之王"])], "chapter long, book string, para_seq int, seq int, uid string, text string")
    known = spark.createDataFrame([(0, ["a"], [], None), (1, ["a", "b"], ["c"], None), (3, [], [], "秦"), (4, [], [], "夏"), (6, [], [], "漢")], "chapter long, owners array<string>, related array<string>, era string")
    title = annotate.Title("王", ("a", "b", "c"), default="c", rules=(("post", "言", "b"),))
    got = {r["uid"]: (r["id"], r["tier"]) for r in annotate.resolve_titles(sents, {"甲": "a", "乙": "b"}, [title], ERAS, ERA_OF, None, known).collect()}
    assert got == {"u0": ("a", "owner"), "u1": ("c", "related"), "u2": ("a", "sentence"), "u3": ("b", "era"), "u4": (None, "none"), "u5": ("b", "sentence"), "u6": ("c", "guess"), "u7": ("b", "sentence")}


def test_feedback_between_titles():
    one_, two = annotate.Title("甲", ("a", "b"), by_book={"x": ("a",)}), annotate.Title("乙", ("a", "b"))
    spots = [(1, 1, one_, annotate.Evidence(book="x")), (1, 1, two, annotate.Evidence(book="x"))]
    assert annotate.resolve_chapter([], spots) == [("a", "era"), ("a", "sentence")]


def test_sentences(spark):
    p = spark.createDataFrame([(1, "b", "zh", 1, "曰：「可。」）然後。未完"), (1, "b", "zh", 2, "")], "chapter long, book string, lang string, para_seq int, text string")
    assert [r["text"] for r in m.split_sentences(p, m.CJK_SENTENCE).orderBy("seq").collect()] == ["曰：「可。」）", "然後。", "未完"]


def test_html():
    h = "a<table class='footer'><tr><td>n<table><tr><td>m</td></tr></table></td></tr></table>b<table><tr><td>x</td><th>y &amp; z</th></tr></table><p>one<p>two</p>"
    assert extract.blocks_of(extract.drop_nav_tables(h)) == [("cell", "x"), ("cell", "y & z"), ("prose", "one"), ("prose", "two")]
    assert extract.note_blocks_out("a<small>1 n<small>m</small></small>b") == "ab"
    assert extract.peeled("a〈b〈c〉〉d〈e") == ("ad", "bc\ne")
    assert extract.peeled("a〉b")[0] == "b"
    assert extract.annotation_ranges("x〈n〉[12]") == [(1, 4), (4, 8)]


def test_text_columns(spark):
    assert one(spark, extract.without_marks(F.col("s")), s="*(甲)**[乙]*丙**丁**") == "乙丙丁"
    assert one(spark, extract.without_links(F.col("s")), s="[[a|b]]{{c}}[[d]]") == "bcd"
    assert one(spark, extract.cleaned(F.col("s")), s="<b>x</b>&lt; y [12]　z") == "x<yz"
    assert one(spark, extract.without_notes(F.col("s")), s="a〈b〈c〉〉d") == "ad"
    assert one(spark, extract.note_text(F.col("s")), s="a〈b〉c〈d") == "b\nd"
    r = one(spark, extract.body_and_note(F.col("s")), s="本文注：說")
    assert (r["body"], r["note"]) == ("本文", "注：說")
    assert one(spark, t.context(F.col("s"), F.lit(1), F.lit(3)), s="甲乙丙丁") == "甲【乙丙】丁"
    assert one(spark, t.norm(F.col("s")), s="説雒") == "說洛"
    assert one(spark, t.alias_kind(F.col("s"), F.lit("x"), ("王",)), s="公孙侨") == "other"
    r = one(spark, t.volume_key(F.col("s")), s="027下之上")
    assert (r["number"], r["part"], r["rest"]) == (27, 3, "下之上")
    assert one(spark, t.real_name(F.col("s")), s="秦王（嬴政）") == "嬴政"
    assert t.books_of("b,a", ["a", "b", "c"]) == ["a", "b"] and t.books_of(None, ["a"]) is None
    with pytest.raises(ValueError):
        t.books_of("z", ["a"])


def test_intervals(spark):
    x = F.from_json(F.col("s"), "array<struct<s:int,e:int>>")
    got = one(spark, index.greedy_intervals(x), s=json.dumps([{"s": 0, "e": 2}, {"s": 0, "e": 4}, {"s": 3, "e": 5}, {"s": 4, "e": 6}]))
    assert [(r["s"], r["e"]) for r in got] == [(0, 4), (4, 6)]


SENT = [{"uid": f"u{k}", "chapter": 1, "para_seq": 1, "seq": k, "text": f"text{k}"} for k in range(4)]


def test_edits():
    got = versions.edit_text(SENT, [{"edit_id": 1, "uid": "u1", "action": "dead", "at": None}, {"edit_id": 2, "uid": "u0", "action": "merge", "at": None}, {"edit_id": 3, "uid": "u0", "action": "split", "at": 4}, {"edit_id": 4, "uid": "u3", "action": "merge", "at": None}, {"edit_id": 5, "uid": "u3", "action": "split", "at": 99}])
    assert [(s["text"], s["status"], s["seq"]) for s in got] == [("text", "active", 0), ("0text2", "active", 0.5), ("text1", "dead", 1), ("", "merged", 2), ("text3", "active", 3)]
    assert versions.edit_text(got, [{"edit_id": 3, "uid": "u0", "action": "split", "at": 2}]) == [dict(s) for s in got]


def test_diff(spark):
    cols = "uid string, s int, e int, surface string, id string, tier string"
    a = spark.createDataFrame([("u", 0, 1, "x", "p", "core"), ("u", 2, 3, "x", "p", "core"), (None, 4, 5, "x", "p", "core"), ("v", 0, 1, "y", "p", "core")], cols)
    b = spark.createDataFrame([("u", 0, 1, "x", "q", "era"), ("u", 2, 3, "x", "p", "era"), (None, 4, 5, "x", "p", "core"), ("w", 0, 1, "y", "p", "core")], cols)
    assert versions.diff(a, a).count() == 0
    assert {r["uid"] + str(r["s"]): r["kind"] for r in versions.diff(a, b).collect()} == {"u0": "pid_changed", "u2": "tier_changed", "v0": "removed", "w0": "added"}


def test_sources(spark, tmp_path):
    waits = []
    answers = iter([(503, ""), (200, '{"k": 1}')])
    assert readers.fetch(lambda p: next(answers), {}, sleep=waits.append) == {"k": 1} and waits == [15]
    with pytest.raises(OSError):
        readers.fetch(lambda p: (404, ""), {}, sleep=waits.append)
    (tmp_path / "sj-001.html").write_text("<title>一、本紀</title>")
    (tmp_path / "sj-027下.html").write_text("x")
    got = readers.raw_pages(spark, str(tmp_path)).orderBy("key").select("code", "slug", readers.page_title(F.col("html"))).collect()
    assert [tuple(r) for r in got] == [("sj", "001", "本紀"), ("sj", "027下", "")]
    (tmp_path / "p.csv").write_text("id,aliases,status\n1,a| b|,active\n2,c,dead\n3,,Active\n")
    assert [tuple(r) for r in readers.sheet(spark, str(tmp_path / "p.csv"), "id string, aliases string, status string", ("aliases",)).select("id", "aliases").collect()] == [("1", ["a", "b"]), ("3", [])]
    (tmp_path / "c.json").write_text(json.dumps({"bookId": "sj", "chapterId": "sj-1", "paragraphs": [{"seq": 1, "sentences": [{"uid": "u", "seq": 1, "text": "t"}]}]}))
    books = spark.createDataFrame([("sj", 1, True)], "code string, ord int, ready boolean")
    assert [tuple(r) for r in readers.corpus(spark, str(tmp_path / "c.json"), books).select("uid", "text", "status").collect()] == [("u", "t", "active")]


def test_listing_pages():
    answers = iter([(200, '{"query": {"allpages": [{"title": "a"}]}, "continue": {"apcontinue": "b"}}'), (200, '{"query": {"allpages": [{"title": "b"}]}}')])
    assert readers.listing(lambda p: next(answers), "x") == ["a", "b"]


def test_sinks(spark, tmp_path):
    s = spark.createDataFrame([("b1", 1, 1, 1, "u", "x"), ("b2", 2, 1, 1, "v", "y")], "book string, chapter long, para_seq int, seq int, uid string, text string")
    sinks.json_by_book(s, str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o")).filter("book = 'b2'").select("sentences.text").first()[0] == ["y"]
    human = sinks.with_human_columns(s.select("uid", "text"), spark.createDataFrame([("u", "note")], "uid string, note string"), "uid", ["note"])
    assert {r["uid"]: r["note"] for r in human.collect()} == {"u": "note", "v": None}
    assert one(spark, sinks.js_safe(F.col("s")), s="a'</b\\") == "a\\'<\\/b\\\\"


def test_stream(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.write.parquet(str(tmp_path / "in"))
    q = incremental.windowed_counts(incremental.event_stream(spark, str(tmp_path / "in"), src.schema)).writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").agg(F.sum("n")).first()[0] == src.count()
