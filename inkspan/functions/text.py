"""Scalar functions as Column builders: identifiers, normalisation, context, kinds, time and geometry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# A sample of the variant forms that are folded one to one; a full table is a parameter.
VARIANTS = {"髙": "高", "巻": "卷", "戸": "戶", "鄕": "鄉", "閒": "間", "歳": "歲", "説": "說", "羣": "群", "眞": "真", "徳": "德", "彊": "強", "竝": "並", "雒": "洛", "钜": "巨"}
SURNAME_PREFIXES = ("公孙", "公子", "公叔", "公伯", "公上", "公玉", "公仪", "公输", "公西", "公羊", "公冶", "公良", "公罔", "公仲", "公皙", "公冉", "公明")
TITLE_MARKS = "王|公|侯|伯|君|帝|后|祖|太后|夫人"
OFFICE_MARKS = "相國|丞相|相国|太尉|太傅|御史|中車府|中车府|將軍|将军|太守|單于|单于|太子|大夫|僕射|令"
FEMALE_HINTS = ("太后", "皇后", "公主", "王后", "夫人", "姬", "妃", "后", "女", "母", "婦", "妻", "娣", "娥")
CALL_INVERSE = {
    "父": ("子", "女"), "母": ("子", "女"), "子": ("父", "母"), "女": ("父", "母"), "祖父": ("孫", "孫女"), "祖母": ("孫", "孫女"), "孫": ("祖父", "祖母"), "孫女": ("祖父", "祖母"),
    "兄": ("弟", "妹"), "弟": ("兄", "姊"), "姊": ("妹", "弟"), "妹": ("兄", "姊"), "夫": ("妻",), "妻": ("夫",), "伯叔": ("姪",), "姑": ("姪",), "姪": ("伯叔", "姑"), "舅": ("甥",), "姨": ("甥",), "甥": ("舅", "姨"),
    "養父": ("子", "女"), "繼母": ("子", "女"),
}
CONFIDENCE = {"manual": 1.0, "ai": 0.8, "auto-summary": 0.6, "manual-guess": 0.4}
NO_EVIDENCE = 0.4
# End of fixed values.


def lookup(table: dict, key: Column) -> Column:
    """The value of a short constant table, or null."""
    return F.element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), key)


def norm(text: Column, variants: dict[str, str] = VARIANTS) -> Column:
    """folds variant characters; lengths and offsets stay."""
    return F.translate(text, "".join(variants), "".join(variants.values()))


def convert(text: Column, chars: dict[str, str], phrases: tuple[tuple[str, str], ...] = ()) -> Column:
    """one-to-one characters first, then phrases, longest first."""
    out = F.translate(text, "".join(chars), "".join(chars.values())) if chars else text
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), sorted(phrases, key=lambda p: (-len(p[0]), p[0])), out)


def query_forms(q: Column, chars: dict[str, str], variants: dict[str, str] = VARIANTS) -> Column:
    """F32: the distinct forms under which a query is looked up."""
    return F.array_distinct(F.array(q, norm(q, variants), convert(q, chars)))


def short_id(*parts: Column) -> Column:
    """the first 12 hex digits of the md5 of the parts joined by a pipe."""
    return F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 12)


def sentence_id(chapter: Column, para: Column, seq: Column) -> Column:
    return F.format_string("%s-%04d-%03d", chapter.cast("string"), para.cast("int"), seq.cast("int"))


def volume_key(slug: Column) -> Column:
    """(number, rank of the part, rest)."""
    digits = F.regexp_extract(slug, r"^(\d+)", 1)
    rest = F.regexp_replace(slug, r"^\d+", "")
    part = F.when(rest == "", 0).when(rest.startswith("上"), 1).when(rest.startswith("中"), 2).when(rest.startswith("下"), 3).when(rest == "b", 9).otherwise(5)
    return F.struct(F.when(digits == "", 9999).otherwise(digits.cast("int")).alias("number"), part.alias("part"), rest.alias("rest"))


def era_index(name: Column, eras: tuple[str, ...]) -> Column:
    """F8: place in the list of eras, null if unknown."""
    at = F.array_position(F.array(*map(F.lit, eras)), name)
    return F.when(at > 0, (at - 1).cast("int"))


def alias_kind(alias: Column, own_name: Column, generics: tuple[str, ...]) -> Column:
    """name, generic, short, title or other."""
    probe = reduce(lambda c, p: F.replace(c, F.lit(p), F.lit("")), SURNAME_PREFIXES, alias)
    return F.when(alias == own_name, "name").when(alias.isin(*generics), "generic").when(F.length(alias) == 1, "short").when(probe.rlike(TITLE_MARKS) | probe.rlike(OFFICE_MARKS), "title").otherwise("other")


def title_like(title: Column, core: Column, suffixes: tuple[str, ...], posthumous: str, ranks: str = "王公侯君") -> Column:
    """F10, loose: the core alone, the core and a suffix, or the core, a posthumous character and a rank."""
    rest = F.substring(title, F.length(core) + 1, F.length(title))
    with_suffix = reduce(lambda a, b: a | b, [rest.startswith(s) for s in suffixes], F.lit(False))
    return title.startswith(core) & ((rest == "") | with_suffix | (F.substring(rest, 1, 1).isin(*posthumous) & rest.rlike(f"[{ranks}]")))


def same_title_family(title: Column, core: Column, suffix: Column, suffixes: tuple[str, ...], posthumous: str) -> Column:
    """F10, strict: the rank must agree too."""
    rest = F.substring(title, F.length(core) + 1, F.length(title))
    strict = (rest != "") & (rest.startswith(suffix) | (F.substring(rest, 1, 1).isin(*posthumous) & F.substring(rest, F.lit(2), F.length(rest)).startswith(suffix)))
    long_suffix = suffix.isin(*suffixes) & (F.length(suffix) > 1)
    return title.startswith(core) & F.when(long_suffix, rest.startswith(suffix)).otherwise(strict)


def context(text: Column, s: Column, e: Column, width: int = 14) -> Column:
    """the span in brackets with up to width code points on each side; s and e are 0-based, end exclusive."""
    a = F.greatest(s - width, F.lit(0))
    return F.concat(F.substring(text, a + 1, s - a), F.lit("【"), F.substring(text, s + 1, e - s), F.lit("】"), F.substring(text, e + 1, F.lit(width)))


def excerpt(text: Column, s: Column, e: Column, before: int = 18, after: int = 22) -> Column:
    """struct(text, s, e) with offsets moved to the excerpt."""
    a = F.greatest(s - before, F.lit(0))
    return F.struct(F.substring(text, a + 1, e + after - a).alias("text"), (s - a).alias("s"), (e - a).alias("e"))


def truncated(text: Column, most: int = 40, keep: int = 38) -> Column:
    """F15."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, keep), F.lit("…"))).otherwise(text)


def looks_female(*texts: Column, hints: tuple[str, ...] = FEMALE_HINTS) -> Column:
    """F16: any hint in any of the texts."""
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit("")).rlike("|".join(hints)) for t in texts])


def inverse_call(rel: Column, other_female: Column, table: dict[str, tuple[str, ...]] = CALL_INVERSE) -> Column:
    """what the other is called from here; the relation itself where the table has none."""
    male, female = lookup({k: v[0] for k, v in table.items()}, rel), lookup({k: v[-1] for k, v in table.items()}, rel)
    return F.coalesce(F.when(other_female, female).otherwise(male), rel)


def confidence(source: Column, has_evidence: Column, table: dict[str, float] = CONFIDENCE, cap: float = NO_EVIDENCE) -> Column:
    """F18."""
    base = F.coalesce(lookup(table, source), F.lit(cap))
    return F.when(has_evidence, base).otherwise(F.least(base, F.lit(cap)))


def books_of(book: str | None, known: list[str]) -> list[str] | None:
    """the chosen books in the registry's order; None means no filter; an unknown one is an error."""
    chosen = [b.strip() for b in (book or "").split(",") if b.strip()]
    if unknown := [b for b in chosen if b not in known]:
        raise ValueError(f"unknown book: {', '.join(unknown)}")
    return None if not chosen or set(chosen) == set(known) else [b for b in known if b in chosen]


def as_int(value: Column) -> Column:
    """17.0 is 17; what is no number is null."""
    return value.try_cast("double").cast("int")


def decoded(json: Column, kind: str) -> Column:
    """a JSON column as array or map; what does not parse is empty."""
    empty = F.array() if kind.lower().startswith("array") else F.create_map()
    return F.coalesce(F.from_json(json, kind), empty.cast(kind))


def real_name(summary: Column) -> Column:
    """a name in brackets within the summary."""
    return F.nullif(F.regexp_extract(summary, r"[（(]([^）)]{1,12})[）)]", 1), F.lit(""))


def former_era(rank: Column, book_from: Column) -> Column:
    """earlier than the book's range; false where either is unknown."""
    return F.coalesce(rank < book_from, F.lit(False))


def project(lng: Column, lat: Column, box: tuple[float, float, float, float], width: float, height: float) -> Column:
    """equirectangular, to a tenth."""
    west, east, south, north = box
    return F.struct(F.round((lng - west) / (east - west) * width, 1).alias("x"), F.round((north - lat) / (north - south) * height, 1).alias("y"))


def tile(lng: Column, lat: Column, zoom: int) -> Column:
    """web-mercator tile."""
    n = float(1 << zoom)
    r = F.radians(lat)
    return F.struct(F.floor((lng + 180.0) / 360.0 * n).alias("x"), F.floor((1.0 - F.log(F.tan(r) + 1.0 / F.cos(r)) / F.pi()) / 2.0 * n).alias("y"))


def tile_corner(x: Column, y: Column, zoom: int) -> Column:
    n = float(1 << zoom)
    return F.struct((x / n * 360.0 - 180.0).alias("lng"), F.degrees(F.atan(F.sinh(F.pi() * (F.lit(1.0) - y * 2.0 / n)))).alias("lat"))


def colour_bucket(year: Column, low: Column, high: Column) -> Column:
    """quarter of the range, 0 to 3; the first where the range is empty."""
    share = F.when(high > low, (year - low) / (high - low)).otherwise(F.lit(0.0))
    return F.when(share < 0.25, 0).when(share < 0.5, 1).when(share < 0.75, 2).otherwise(3)


def hit_span(text: Column, surface: Column, s: Column, e: Column) -> Column:
    """the span if it holds the surface, else the surface's first place, else null."""
    at = F.position(surface, text)
    n = F.length(surface)
    return F.when(F.substring(text, s + 1, e - s) == surface, F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"))).when(at > 0, F.struct((at - 1).cast("int").alias("s"), (at - 1 + n).cast("int").alias("e")))


def scope_count(by_book: Column, books: list[str] | None, total: Column) -> Column:
    """the total, or the sum over the chosen books."""
    if books is None:
        return total
    return F.aggregate(F.map_values(F.map_filter(by_book, lambda k, v: k.isin(*books))), F.lit(0).cast("long"), lambda a, v: a + v)


def name_like(name: Column, surnames: tuple[str, ...], bad_tails: str, longest: int = 4) -> Column:
    """begins with a surname, has two to `longest` characters, and ends in none of the bad ones."""
    return F.length(name).between(2, longest) & reduce(lambda a, b: a | b, [name.startswith(s) for s in surnames], F.lit(False)) & ~F.substring(name, -1, 1).isin(*bad_tails)


def ambiguous(name: Column, titles: tuple[str, ...]) -> Column:
    """is or ends in a title that many bear."""
    return name.rlike("(?:" + "|".join(titles) + ")$")


def parse_year(text: Column, eras: dict[str, int], numerals: dict[str, int], leads: tuple[str, ...]) -> Column:
    """struct(raw, year) of the first era year in the text; year is null where the era is unknown."""
    pattern = r"([^\s，。；]{2,5}?)(元|[一二三四五六七八九十]{1,3})年"
    raw = F.regexp_extract(text, pattern, 0)
    era = F.regexp_replace(F.regexp_extract(text, pattern, 1), "^(?:" + "|".join(leads) + ")", "")
    n = F.regexp_extract(text, pattern, 2)
    year = lookup(eras, era) + F.coalesce(lookup(numerals, n), F.lit(1)) - 1
    detail = F.regexp_extract(text, pattern + r"([春夏秋冬]?(?:[正二三四五六七八九十][一二]?月)?)", 3)
    return F.when(raw != "", F.struct(F.when(year.isNotNull(), F.concat(raw, detail)).otherwise(raw).alias("raw"), year.alias("year")))
