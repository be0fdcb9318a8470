"""From raw HTML to text blocks. What is regular is done by expressions; nested tables and blocks, which are not, by an
Arrow-batched function."""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Classes of navigation tables, and words that mark boilerplate.
NAV_CLASSES = ("ws-header", "footer", "ws-noexport", "noexport")
NAV_WORDS = ("维基文库", "維基文庫", "版权", "版權", "姊妹计划", "姊妹計劃")
# End of fixed values.


def stripped(html: Column) -> Column:
    """H1: comments, styles and scripts out."""
    return F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", " "), r"(?is)<(style|script)\b.*?</\1\s*>", " ")


def without_marks(text: Column) -> Column:
    """H7: corrections: the new reading stays, the old goes."""
    for pattern, to in ((r"\*\(([^)]*)\)\*\*\[([^\]]*)\]\*", "$2"), (r"\*\[([^\]]*)\]\*", "$1"), (r"\*\([^)]*\)\*", ""), (r"\*\*([^*]+)\*\*", "$1")):
        text = F.regexp_replace(text, pattern, to)
    return text


def without_links(text: Column) -> Column:
    """H8."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\[\[[^\]|]*\|([^\]]*)\]\]", "$1"), r"\[\[([^\]]*)\]\]", "$1"), r"\{\{|\}\}", "")


def cleaned(html: Column) -> Column:
    """H9: tags out, common entities back, footnote marks and all white space out."""
    text = F.regexp_replace(html, r"<[^>]*>", "")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(text, r"\[\d+\]|\^\d+\.\d+", ""), r"[\s 　]+", "")


def without_notes(text: Column, depth: int = 4) -> Column:
    """H5: angle-bracket notes, however deep they are nested. The innermost `depth` levels go by patterns; what is left is
    read with a stack of the texts after each open bracket. Brackets without a partner stay."""
    rest = reduce(lambda c, _: F.regexp_replace(c, "〈[^〈〉]*〉", ""), range(depth), text)

    def step(acc: Column, x: Column) -> Column:
        n = F.size(acc)
        more = F.concat(F.slice(acc, F.lit(1), n - 1), F.array(F.concat(F.element_at(acc, -1), x)))
        return F.when(x == "〈", F.concat(acc, F.array(F.lit("")))).when((x == "〉") & (n > 1), F.slice(acc, F.lit(1), n - 1)).otherwise(more)

    return F.aggregate(F.regexp_extract_all(rest, F.lit("[〈〉]|[^〈〉]+"), F.lit(0)), F.array(F.lit("")), step, lambda acc: F.array_join(acc, "〈"))


def peeled(text: str) -> tuple[str, str]:
    """H6: (body, notes); a note without end runs to the end, an end without start begins at the start."""
    body, notes, depth, note = [], [], 0, []
    for ch in text:
        if ch == "〈":
            depth += 1
        elif ch == "〉":
            if depth:
                depth -= 1
            else:
                note, body = body, []
            if not depth:
                notes.append("".join(note))
                note = []
        else:
            (note if depth else body).append(ch)
    if note:
        notes.append("".join(note))
    return "".join(body), "\n".join(n for n in notes if n)


def note_text(para: Column) -> Column:
    """Contents of brackets, a line each."""
    return F.array_join(F.regexp_extract_all(para, F.lit("〈([^〈〉]*)(?:〉|\\z)"), F.lit(1)), "\n")


def body_and_note(para: Column, heads: tuple[str, ...] = ("注：", "校勘記", "【注】")) -> Column:
    """Split at the earliest head; a paragraph that begins with a page and line number is all note."""
    pattern = "|".join(heads)
    whole = para.rlike(r"^\d+\.\d+")
    body = F.split(para, pattern, 2)[0]
    return F.struct(F.when(whole, "").otherwise(body).alias("body"), F.when(whole, para).otherwise(F.substring(para, F.length(body) + 1, F.length(para))).alias("note"))


def is_nav(text: Column, kind: Column, words: tuple[str, ...] = NAV_WORDS) -> Column:
    """H11."""
    short = F.length(text) < F.when(kind == "cell", 2).otherwise(4)
    bars = (F.instr(text, "|") > 0) & (F.length(text) < 60)
    return (text == "") | short | text.rlike("^【[^】]*】$") | bars | text.rlike("|".join(words))


#: A title's genre by what it begins with, in this order, then by what it ends with once its part mark is off.
GENRE_HEADS = (("载记", ("載記", "载记")), ("列传", ("列傳", "列传", "傳")), ("本纪", ("帝紀", "帝纪", "本紀", "本纪")), ("书", ("志",)))
GENRE_TAILS = (("世家", ("世家",)), ("列传", ("列传", "列傳", "傳")), ("本纪", ("本纪", "本紀", "紀")), ("表", ("表",)), ("书", ("书", "書", "志")))
PREFACE, PREFACE_GENRE, HELD_ANYWHERE, NO_GENRE = "太史公自序", "列传", "載記", "其他"
PART_MARK = "(?:上|中|下|[一二三四五六七八九十])(?:之[上下])?$"


def genre(title: Column) -> Column:
    """H13. A title that is nothing but a part mark keeps it."""
    stem = F.regexp_replace(title, PART_MARK, "")
    stem = F.when(stem == "", title).otherwise(stem)
    found = F.when(stem == PREFACE, PREFACE_GENRE).when(F.contains(title, F.lit(HELD_ANYWHERE)), GENRE_HEADS[0][0])
    for kinds, test, text in ((GENRE_HEADS, F.startswith, title), (GENRE_TAILS, F.endswith, stem)):
        for kind, marks in kinds:
            for mark in marks:
                found = found.when(test(text, F.lit(mark)), kind)
    return found.otherwise(NO_GENRE)


_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)\b([^>]*)>")


def drop_nav_tables(html: str, classes: tuple[str, ...] = NAV_CLASSES) -> str:
    """H2: tables of a navigation class, with all that is nested in them."""
    out, at, depth, skip = [], 0, 0, 0
    for t in _TAG.finditer(html):
        if t[2].lower() != "table":
            continue
        if not t[1]:
            depth += 1
            if not skip and any(c in t[3] for c in classes):
                out.append(html[at : t.start()])
                skip = depth
        elif depth:
            if skip == depth:
                at, skip = t.end(), 0
            depth -= 1
    return "".join(out) + ("" if skip else html[at:])


def blocks_of(html: str) -> list[tuple[str, str]]:
    """H3: (cell or prose, text) in order; a block ends where the next begins or its element ends."""
    found, kind, start = [], None, 0
    kinds = {"td": "cell", "th": "cell", "p": "prose", "dd": "prose", "li": "prose"}

    def close(end: int) -> None:
        if kind:
            text = htmllib.unescape(_TAG.sub("", html[start:end]))
            text = re.sub(r"\s+", " ", text).strip()
            if text:
                found.append((kind, text))

    for t in _TAG.finditer(html):
        name = t[2].lower()
        if name in kinds:
            close(t.start())
            kind, start = (None if t[1] else kinds[name]), t.end()
        elif name == "table" and kind:
            close(t.start())
            kind = None
    close(len(html))
    return found


def page_blocks(pages: DataFrame) -> DataFrame:
    """page_id, at, kind, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, k, kind, text) for p, h in zip(pdf["page_id"], pdf["html"]) for k, (kind, text) in enumerate(blocks_of(drop_nav_tables(h or "")))]
            yield pd.DataFrame(rows, columns=["page_id", "at", "kind", "text"])

    return pages.select("page_id", stripped(F.col("html")).alias("html")).mapInPandas(run, "page_id long, at int, kind string, text string")


def note_blocks_out(html: str, marker: str = "small", most: int = 200) -> str:
    """H4: drops <small> blocks that are numbered or shorter than `most` characters, paired by nesting."""
    out, stack, at = [], [], 0
    for t in _TAG.finditer(html):
        if t[2].lower() != marker:
            continue
        if not t[1]:
            stack.append(t.start())
        elif stack:
            begin = stack.pop()
            inner = _TAG.sub("", html[begin : t.start()])
            if not stack and begin >= at and (len(inner) < most or re.match(r"\s*[\[〔(]?\d+", inner)):
                out.append(html[at:begin])
                at = t.end()
    return "".join(out) + html[at:]


def paragraph_offsets(sents: DataFrame) -> DataFrame:
    """Each sentence's offset in its paragraph, a running sum of lengths."""
    from pyspark.sql import Window

    w = Window.partitionBy("chapter", "para_seq").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return sents.withColumn("offset", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)))


def annotation_ranges(text: str) -> list[tuple[int, int]]:
    """Ranges of angle notes and bracketed numbers."""
    return [m.span() for m in re.finditer(r"〈[^〉]*〉|\[\d+\]", text)]
