"""Lines, sentences and segments as arrays: joining, splitting, packing and merging, without a shuffle.

Each function takes and returns Columns; a document stays on its row. Folds run over one document's units.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.functions import vocabulary as V

_UNITS = r"[^。！？；\n]*[。！？；\n]|[^。！？；\n]+"


def _empty() -> Column:
    return F.array().cast("array<string>")


def join_lines(text, variant: str = "rule") -> Column:
    """Page markers go; a line that does not end its sentence takes the next line, by a space, unless that
    is blank or starts a list item or section. The test looks at neighbouring lines only."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~T.is_page_marker(x, variant))
    facts = F.transform(
        lines,
        lambda x: F.struct(
            x.alias("raw"), T.strip(x).alias("line"), (~T.is_blank(x) & ~T.is_terminated(x, variant)).alias("open"),
            (~T.is_blank(x) & ~T.is_list_item(x, variant) & ~T.is_section_start(x, variant)).alias("goes_on"),
        ),
    )

    def emit(all_):
        def one(x, i):
            joined = (i > 0) & x.goes_on & F.get(all_, i - 1).open
            return F.concat(F.when(i == 0, "").when(joined, " ").otherwise("\n"), F.when(joined | x.open, x.line).otherwise(x.raw))

        return F.array_join(F.transform(all_, one), "")

    return F.get(F.transform(F.array(facts), emit), 0)


def line_groups(lines_df, variant: str = "rule"):
    """lines_df: doc_id, line_no, line. Adds group_no (lines that the joiner joins) by a running sum over a
    neighbour test, without the page markers."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("line_no")
    kept = lines_df.where(~T.is_page_marker(F.col("line"), variant))
    line = F.col("line")
    flags = kept.withColumn("open", ~T.is_blank(line) & ~T.is_terminated(line, variant)).withColumn(
        "starts", F.when(T.is_blank(line) | T.is_list_item(line, variant) | T.is_section_start(line, variant) | ~F.coalesce(F.lag("open").over(w), F.lit(False)), 1).otherwise(0)
    )
    return flags.withColumn("group_no", F.sum("starts").over(w)).drop("starts", "open")


def paragraphs(text) -> Column:
    return F.filter(F.transform(F.split(text, rf"\n{T.W}*\n"), T.strip), lambda p: p != "")


def _fold(units, start, step, finish) -> Column:
    return F.aggregate(units, start, step, finish)


def _state(done=None, cur=None) -> Column:
    return F.struct((_empty() if done is None else done).alias("done"), (F.lit("") if cur is None else cur).alias("cur"))


def _push(done, cur) -> Column:
    return F.concat(done, F.array(cur))


def pack_sentences(text, most: int = V.LONG_PARAGRAPH) -> Column:
    """Sentences (up to one of 。！？； or a line end) packed while they fit; a longer one stays whole."""

    def step(a, u):
        over = F.length(a.cur) + F.length(u) > most
        return _state(F.when(over & (a.cur != ""), _push(a.done, T.strip(a.cur))).otherwise(a.done), F.when(over, u).otherwise(F.concat(a.cur, u)))

    got = _fold(F.regexp_extract_all(text, F.lit(_UNITS), F.lit(0)), _state(), step, lambda a: F.when(T.is_blank(a.cur), a.done).otherwise(_push(a.done, T.strip(a.cur))))
    return F.get(F.transform(F.array(got), lambda g: F.when(F.size(g) > 0, g).otherwise(F.array(text))), 0)


def list_line_ratio(text, variant: str = "rule") -> Column:
    lines = F.split(text, "\n")
    return F.size(F.filter(lines, lambda x: T.is_list_item(x, variant))) / F.size(lines)


def pack_list(text, most: int = V.LONG_PARAGRAPH) -> Column:
    """Lines packed while they fit; a list item and the lines that continue it are never parted."""
    atom = "array<struct<text:string,size:int,item:boolean,grow:boolean>>"

    def gather(a, x):
        item, blank = T.is_list_item(x), T.is_blank(x)
        last = F.get(a, F.size(a) - 1)
        goes_on = ~item & ~blank & F.coalesce(last.grow, F.lit(False))
        longer = F.struct(F.concat(last.text, F.lit("\n"), x).alias("text"), (last.size + F.length(x) + 1).alias("size"), last.item.alias("item"), F.lit(True).alias("grow"))
        new = F.struct(x.alias("text"), F.length(x).alias("size"), item.alias("item"), item.alias("grow"))
        return F.when(goes_on, F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(a, F.array(new))).cast(atom)

    atoms = F.aggregate(F.split(text, "\n"), F.array().cast(atom), gather)
    start = F.struct(_empty().alias("done"), F.lit("").alias("cur"), F.lit(0).alias("size"), F.lit(False).alias("any"))

    def step(a, x):
        flush = (a.size + x.size > most) & a.any
        return F.struct(
            F.when(flush, _push(a.done, a.cur)).otherwise(a.done).alias("done"),
            F.when(flush | ~a.any, x.text).otherwise(F.concat(a.cur, F.lit("\n"), x.text)).alias("cur"),
            (F.when(flush, 0).otherwise(a.size) + x.size + F.when(x.item, 0).otherwise(1)).alias("size"),
            F.lit(True).alias("any"),
        )

    return F.aggregate(atoms, start, step, lambda a: F.when(a.any, _push(a.done, a.cur)).otherwise(a.done))


def split_long(paragraph, most: int = V.LONG_PARAGRAPH) -> Column:
    """Over-long paragraphs: by list items if more than three tenths of the lines are some, else by sentences."""
    return F.when(list_line_ratio(paragraph) > 0.3, pack_list(paragraph, most)).otherwise(pack_sentences(paragraph, most))


def merge_short(segments, least: int = V.SHORT_SEGMENT, most: int = V.LONG_PARAGRAPH) -> Column:
    """Greedy: a short segment always joins what is held; another joins while both lengths stay below most."""

    def step(a, s):
        none, short = a.cur == "", F.length(s) < least
        fits = F.length(a.cur) + F.length(s) < most
        both = F.concat(a.cur, F.lit("\n"), s)
        return _state(
            F.when(~none & ~short & ~fits, _push(a.done, a.cur)).otherwise(a.done), F.when(none, s).when(short, T.strip(both)).when(fits, both).otherwise(s)
        )

    return F.aggregate(segments, _state(), step, lambda a: F.when(a.cur != "", _push(a.done, a.cur)).when(F.size(a.done) > 0, a.done).otherwise(segments))


def rule_segments(text) -> Column:
    """Clean, join lines, cut into paragraphs, split long ones, merge short ones."""
    parts = F.transform(paragraphs(join_lines(T.clean_text(text))), lambda p: F.when(F.length(p) > V.LONG_PARAGRAPH, split_long(p)).otherwise(F.array(p)))
    return F.get(F.transform(F.array(F.flatten(parts)), lambda p: merge_short(p)), 0)


def presegment(text, most: int = V.PRESEGMENT) -> Column:
    """Sentences of each paragraph, packed while they stay below most characters."""

    def sentences(p):
        units = F.transform(
            F.regexp_extract_all(p, F.lit(_UNITS), F.lit(0)),
            lambda u: F.struct(T.strip(F.regexp_replace(u, r"[。！？；\n]\z", "")).alias("body"), F.regexp_extract(u, r"[。！？；\n]\z", 0).alias("end")),
        )
        return F.transform(F.filter(units, lambda u: u.body != ""), lambda u: F.concat(u.body, u.end))

    def pack(p):
        def step(a, s):
            fits = F.length(a.cur) + F.length(s) < most
            return _state(F.when(~fits & (a.cur != ""), _push(a.done, T.strip(a.cur))).otherwise(a.done), F.when(fits, F.concat(a.cur, s)).otherwise(s))

        return F.aggregate(sentences(p), _state(), step, lambda a: F.when(T.is_blank(a.cur), a.done).otherwise(_push(a.done, T.strip(a.cur))))

    return F.flatten(F.transform(paragraphs(text), pack))


def fallback_merge(segments, below: int = V.SHORT_FALLBACK) -> Column:
    """Segments joined by line ends while both lengths stay below a limit."""

    def step(a, s):
        none, fits = a.cur == "", F.length(a.cur) + F.length(s) < below
        return _state(
            F.when(~none & ~fits, _push(a.done, a.cur)).otherwise(a.done), F.when(none | ~fits, s).otherwise(T.strip(F.concat(a.cur, F.lit("\n"), s)))
        )

    return F.aggregate(segments, _state(), step, lambda a: F.when(a.cur != "", _push(a.done, a.cur)).when(F.size(a.done) > 0, a.done).otherwise(segments))


def merge_neighbours(segments) -> Column:
    """Neighbours that read as one (see should_merge, with all that is merged so far) are joined."""
    start = F.struct(_empty().alias("done"), F.lit("").alias("cur"), F.lit(False).alias("any"))

    def step(a, s):
        joins = a.any & T.should_merge(a.cur, s)
        return F.struct(
            F.when(a.any & ~joins, _push(a.done, a.cur)).otherwise(a.done).alias("done"), F.when(joins, F.concat(a.cur, F.lit("\n"), s)).otherwise(s).alias("cur"), F.lit(True).alias("any")
        )

    return F.aggregate(segments, start, step, lambda a: F.when(a.any, _push(a.done, a.cur)).otherwise(a.done))


def unified_blocks(text, most: int = V.UNIFIED_BLOCK, strict: bool = False) -> Column:
    """Paragraphs packed into blocks. A longer paragraph stays whole; strict clips it as a prompt would."""

    def step(a, p):
        over = F.length(a.cur) + F.length(p) > most
        return _state(
            F.when(over & (a.cur != ""), _push(a.done, T.strip(a.cur))).otherwise(a.done), F.when(over | (a.cur == ""), p).otherwise(F.concat(a.cur, F.lit("\n\n"), p))
        )

    got = F.aggregate(F.split(text, rf"\n{T.W}*\n"), _state(), step, lambda a: F.when(T.is_blank(a.cur), a.done).otherwise(_push(a.done, T.strip(a.cur))))
    got = F.get(F.transform(F.array(got), lambda g: F.when(F.size(g) > 0, g).otherwise(F.array(text))), 0)
    return F.transform(got, lambda b: F.substring(b, 1, most)) if strict else got


def numbered_prompt(sentences) -> Column:
    return F.array_join(F.transform(sentences, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)), "\n")


def explode_segments(df, segments: str = "segments"):
    """doc_id, segment_id (from 1), content."""
    return df.select("doc_id", F.posexplode(segments).alias("pos", "content")).select("doc_id", (F.col("pos") + 1).alias("segment_id"), "content")
