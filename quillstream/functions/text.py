"""Text expressions: strip, clean, line predicates in three variants, truncation, fuzzy tags, samples.

All are Column expressions, so they stay in the JVM. White space and digits are Unicode's, as in Python.
Variants: "rule", "semantic" and "unified" differ in what starts a line, ends a sentence and marks a page.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstream.functions import vocabulary as V

W = r"(?U:[\s\x1c-\x1f])"
NOT_W = r"(?U:[^\s\x1c-\x1f])"
D = r"(?U:\d)"
CN = "一二三四五六七八九十"
VARIANTS = ("rule", "semantic", "unified")
_SENTENCE_END = "。！？；.!?"


def _check(variant: str) -> None:
    if variant not in VARIANTS:
        raise ValueError(f"variant must be one of {VARIANTS}")


def strip(c) -> Column:
    return F.regexp_replace(c, rf"\A{W}+|{W}+\z", "")


def rstrip(c) -> Column:
    return F.regexp_replace(c, rf"{W}+\z", "")


def is_blank(c) -> Column:
    return ~c.rlike(NOT_W)


def clean_text(c) -> Column:
    """Line ends to \\n, runs of three or more to two, each line and the whole stripped."""
    one = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"\n{3,}", "\n\n")
    return strip(F.array_join(F.transform(F.split(one, "\n"), strip), "\n"))


def _list_forms(variant: str) -> list[str]:
    unified = variant == "unified"
    return [
        rf"{D}+[.、]", rf"[(（]{D}+[)）]", "[①-⑩]" if unified else "[①-⑳]", rf"第[{CN}]+[条款项]" if unified else rf"第[{CN}百]+",
        "[a-zA-Z][.、)）]", rf"[{CN}]+[、.]", rf"[-•·]{W}+",
    ]


def is_list_item(c, variant: str = "rule") -> Column:
    _check(variant)
    return strip(c).rlike(r"\A(?:" + "|".join(_list_forms(variant)) + ")")


def is_section_start(c, variant: str = "rule") -> Column:
    """Starts a paragraph or section, without being a list item first."""
    _check(variant)
    if variant == "semantic":
        return F.lit(False)
    if variant == "rule":
        return strip(c).rlike(rf"\A[(（][{CN}]+[)）]{W}*{NOT_W}")
    return strip(c).rlike(rf"\A(?:[{CN}]+[、.]{W}*{NOT_W}|第[{CN}百]+[章节部分]|{D}+\.{D}+{W}+)")


def list_type(c, variant: str = "rule") -> Column:
    _check(variant)
    s = strip(c)
    forms = [("num_dot", rf"{D}+[.、]"), ("paren_num", rf"[(（]{D}+[)）]"), ("circle", "[①-⑳]" if variant == "rule" else "[①-⑩]"), ("di_tiao", rf"第[{CN}百]+"), ("cn_num", rf"[{CN}]+[、.]")]
    if variant != "rule":
        forms.append(("letter", "[a-zA-Z][.、)）]"))
    out = F.when(s.rlike(r"\A" + forms[0][1]), forms[0][0])
    for name, form in forms[1:]:
        out = out.when(s.rlike(r"\A(?:" + form + ")"), name)
    return out.otherwise("other")


def is_terminated(c, variant: str = "rule") -> Column:
    _check(variant)
    ends = _SENTENCE_END + "…" + ("" if variant == "unified" else "\"）)")
    return c.rlike(rf"[{ends}]{W}*\z")


def is_page_marker(c, variant: str = "rule") -> Column:
    _check(variant)
    forms = [rf"[-—]{W}*{D}+{W}*[-—]", rf"{D}+", rf"第{W}*{D}+{W}*页"]
    if variant != "unified":
        forms.append(rf"(?i:page){W}*{D}+")
    return strip(c).rlike(r"\A(?:" + "|".join(forms) + r")\z")


def chinese_number(c) -> Column:
    """Numerals up to the hundreds: digits add, 十 and 百 multiply what stands before them (one if nothing)."""
    digit = F.create_map(*[F.lit(x) for k, n in zip("一二三四五六七八九", range(1, 10)) for x in (k, n)])
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("held"))

    def step(acc, x):
        unit = F.when(x == "十", 10).when(x == "百", 100)
        d = F.coalesce(digit[x], F.lit(0))
        return F.struct(
            (acc.total + F.coalesce(F.greatest(acc.held, F.lit(1)) * unit, F.lit(0))).alias("total"), F.when(unit.isNotNull(), 0).otherwise(d).alias("held")
        )

    return F.aggregate(F.split(c, ""), start, step, lambda acc: acc.total + acc.held)


def truncate_sentence(c, most: int) -> Column:
    """At the last sentence end within `most` characters if that lies beyond the middle, else a hard cut."""
    head = F.substring(c, 1, most)
    kept = F.regexp_extract(head, r"\A[\s\S]*[" + _SENTENCE_END + "]", 0)
    return F.when(F.length(c) <= most, c).when(F.length(kept) - 1 > most * 0.5, kept).otherwise(head)


CLIPS = {"single": (3000, "..."), "batch": (500, "..."), "unified": (8000, "\n..."), "abstract": (10000, "..."), "unified_single": (3000, "")}


def clip(c, kind: str) -> Column:
    """Texts as prompts hold them: cut at a length, with a mark."""
    n, mark = CLIPS[kind]
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def fuzzy_tag(c, variant: str = "rule") -> Column:
    """The first tag, in order, one of whose keywords the text contains; else the fallback."""
    low = F.lower(c)
    out = None
    for tag, words in V.TAG_KEYWORDS:
        found = F.lit(False)
        for w in [*words, *([V.UNIFIED_EXTRA[1]] if variant == "unified" and tag == V.UNIFIED_EXTRA[0] else [])]:
            found = found | c.contains(w) | (F.lit(False) if variant == "unified" else low.contains(w))
        out = F.when(found, tag) if out is None else out.when(found, tag)
    return out.otherwise(V.OTHER)


def valid_tag(c, variant: str = "rule") -> Column:
    """A tag as it stands if it is one, else a fuzzy match; null is the fallback."""
    return F.when(c.isNull(), V.OTHER).when(c.isin(V.TAGS), c).otherwise(fuzzy_tag(c, variant))


def tag_scan(c) -> Column:
    """The first tag that a response contains, with 0.7; the fallback with 0.5."""
    held = F.filter(F.array(*map(F.lit, V.TAGS)), lambda t: F.contains(c, t))
    return F.struct(F.coalesce(F.get(held, 0), F.lit(V.OTHER)).alias("tag"), F.when(F.size(held) > 0, 0.7).otherwise(0.5).alias("confidence"))


def clamp(c) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def sample(c, n: int) -> Column:
    """The first n characters that are no white space."""
    return F.substring(F.regexp_replace(c, W, ""), 1, n)


def should_merge(before, after) -> Column:
    """Whether two neighbouring segments read as one."""
    open_end = ~strip(before).rlike(rf"[{_SENTENCE_END}]\z")
    goes_on = strip(after).rlike(r"\A(?:[a-z]|" + "|".join(V.CONNECTIVES) + ")")
    return open_end | goes_on | ((F.length(before) < 100) & (F.length(after) < 100))
