"""Hand-derived cases of the core operators."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.functions import vocabulary as V
from quillstream.operators import assemble, chunks, labels, packing
from quillstream.plans import parse
from quillstream.sources import documents
from quillstream.streaming import tasks


def one(spark, make, *values):
    """The value of an expression over literal columns a, b, ..."""
    names = "abcdef"[: len(values)]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'string'}" for n, v in zip(names, values)))
    return df.select(make(*[F.col(n) for n in names]).alias("x")).first().x


def test_metadata(spark):
    h = parse.health(spark).first()
    assert (h.status, h.version) == ("healthy", "1.0.0") and h.service
    got = [r.tag for r in parse.tags(spark).orderBy("tag_order").collect()]
    assert len(got) == 13 and {"标题", "摘要", "其他"} <= set(got)
    assert {r.suffix for r in parse.formats(spark).collect()} == {".txt", ".pdf", ".doc", ".docx"}


@pytest.mark.parametrize(
    ("variant", "lines", "want"),
    [
        ("rule", ["本项目研究", "结构解析。"], "本项目研究 结构解析。"),
        ("rule", ["本项目研究", "- 3 -", "结构解析。"], "本项目研究 结构解析。"),
        ("rule", ["本项目研究", "", "结构解析。"], "本项目研究\n\n结构解析。"),
        ("rule", ["内容如下：", "1. 甲", "乙。"], "内容如下：\n1. 甲 乙。"),
        ("rule", ["内容如下：", "甲。"], "内容如下： 甲。"),
        ("rule", ["见表（二）", "下文"], "见表（二）\n下文"),
        ("unified", ["见表（二）", "下文"], "见表（二） 下文"),
        ("rule", ["Page 7"], ""),
        ("unified", ["Page 7"], "Page 7"),
        ("rule", ["前文", "（一）概述"], "前文\n（一）概述"),
        ("semantic", ["前文", "（一）概述"], "前文 （一）概述"),
    ],
)
def test_join_lines(spark, variant, lines, want):
    assert one(spark, lambda a: packing.join_lines(a, variant), "\n".join(lines)) == want


def test_packing(spark):
    assert one(spark, lambda a: packing.pack_sentences(a, 8), "一二三。四五。六七八九。十") == ["一二三。四五。", "六七八九。十"]
    assert one(spark, lambda a: packing.pack_sentences(a, 8), "一二三四五六七八九。十。") == ["一二三四五六七八九。", "十。"]
    for sizes, want in (([10, 60, 60], [132]), ([2000, 999], [3000]), ([2000, 1000], [2000, 1000]), ([2000, 1000, 40], [2000, 1041]), ([2980, 40], [3021]), ([2000, 900, 200], [2901, 200])):
        assert [len(x) for x in one(spark, packing.merge_short, ["x" * n for n in sizes])] == want
    text = "\n".join(["1. " + "a" * 20, "more", "2. " + "b" * 20, "plain"])
    assert one(spark, lambda a: packing.pack_list(a, 30), text) == ["1. " + "a" * 20 + "\nmore", "2. " + "b" * 20 + "\nplain"]
    assert one(spark, packing.merge_neighbours, ["甲乙", "丙。", "X" * 120 + "。", "因此丁。"]) == ["甲乙\n丙。", "X" * 120 + "。\n因此丁。"]
    assert one(spark, lambda a: packing.unified_blocks(a, 10), "甲甲甲甲\n\n乙乙\n\n丙丙丙丙丙") == ["甲甲甲甲\n\n乙乙", "丙丙丙丙丙"]
    assert one(spark, packing.presegment, "甲。 乙。\n\n丙") == ["甲。乙。", "丙"]


def test_functions(spark):
    for s, n in (("三", 3), ("十", 10), ("十二", 12), ("二十", 20), ("二十五", 25), ("百", 100), ("一百二十", 120)):
        assert one(spark, T.chinese_number, s) == n
    assert one(spark, lambda a: T.truncate_sentence(a, 10), "一二三四五六。七八九十一") == "一二三四五六。"
    assert one(spark, lambda a: T.truncate_sentence(a, 9), "一二。三四五六七八九十") == "一二。三四五六七八"
    assert one(spark, lambda a: T.truncate_sentence(a, 10), "一二三四五。六七八九十") == "一二三四五。六七八九"
    assert one(spark, T.clean_text, "  a\r\nb\r\n\r\n\r\n\r\nc  ") == "a\nb\n\nc"
    assert one(spark, T.fuzzy_tag, "科学意义") == "项目研究意义"
    assert one(spark, lambda a: T.fuzzy_tag(a, "unified"), "必要性") == "项目研究意义"
    assert one(spark, lambda a: T.clip(a, "batch"), "x" * 501) == "x" * 500 + "..."
    assert one(spark, lambda a: T.list_type(a), "(3) x") == "paren_num"


def test_chunks(spark):
    cases = [("aaaa. bbbb. cccc. dddd.", 10, 3, [(0, 10, "aaaa. bbbb"), (7, 17, "bbb. cccc."), (14, 23, "cc. dddd.")]), ("abcdefghijklmnop", 6, 2, [(0, 6, "abcdef"), (4, 10, "efghij"), (8, 14, "ijklmn"), (12, 16, "mnop")])]
    for text, size, overlap, want in cases:
        assert chunks.chunk_text(text, size, overlap) == want
        assert [tuple(x) for x in one(spark, lambda a: chunks.sliding_chunks(a, size, overlap), text)] == want
    assert [x[:2] for x in chunks.chunk_text("abcdefghijklmnop", 6, 5)] == [(0, 6), (3, 9), (6, 12), (9, 15), (12, 16)]
    assert [x[:2] for x in chunks.chunk_text("一二三。四五六。七八九。", 6, 0)] == [(0, 4), (4, 8), (8, 12)]
    got = one(spark, lambda a, b: chunks.locate_chunks(a, b), '[{"content": "甲乙"}, {"content": " "}, {"content": "丁"}]', "甲乙丙丁")
    assert [tuple(x) for x in got] == [(0, 2, "甲乙"), (3, 4, "丁")]
    assert [tuple(x) for x in one(spark, lambda a, b: chunks.locate_chunks(a, b), "no", "甲乙")] == [(0, 2, "甲乙")]
    segs = spark.createDataFrame([(1, 1, "x", "ab"), (1, 2, "x", "  "), (1, 3, "x", "c" * 130)], "doc_id long, segment_id int, tag string, content string")
    rows = chunks.number_chunks(chunks.chunk_segments(segs, 50, 10)).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.segment_id) for r in rows] == [(1, 1), (2, 3), (3, 3), (4, 3)]
    sem = chunks.semantic_chunks(segs, lambda c, n: ["c" * 60, "c" * 70], 50).where("segment_id = 3").collect()
    assert [(r.start_pos, r.end_pos) for r in sem] == [(0, 60), (60, 130)]


def test_parsers(spark):
    single = lambda s: tuple(one(spark, labels.parse_single, s))
    assert single('{"tag":"摘要","confidence":1.7}') == ("摘要", 1.0)
    assert single('{"tag":"研究目的","confidence":0.8}') == ("研究目标", 0.8)
    assert single("属于技术路线") == ("技术路线", 0.7)
    assert single("hello") == ("其他", 0.5)
    batch = lambda s, n: [tuple(x) for x in one(spark, lambda a: labels.parse_batch(a, F.lit(n)), s)]
    assert batch('[{"id":2,"tag":"标题","confidence":0.9},{"id":1,"tag":"摘要"}]', 2) == [("标题", 0.9), ("摘要", 0.5)]
    assert batch("段落1：摘要", 2) == [("摘要", 0.7), ("其他", 0.5)]
    plan = lambda p: one(spark, lambda a, b: labels.apply_plan(a, b), ["s1", "s2", "s3", "s4"], p)
    assert plan('{"segments": [[1,2],[3,4]]}') == ["s1\ns2", "s3\ns4"]
    assert plan('{"segments": [[2,1],[2,9]]}') == ["s2\ns1", "s3", "s4"]
    assert plan("no json") == ["s1", "s2", "s3", "s4"]
    got = one(spark, labels.parse_unified, 'x {"segments": [{"content": " 甲 ", "tag": "意义"}, {"content": ""}]}')
    assert [tuple(x) for x in got] == [("甲", "项目研究意义", 0.5)]


def _rows(spark, rows):
    return spark.createDataFrame([(1, i + 1, c, t, float(p)) for i, (c, t, p) in enumerate(rows)], "doc_id long, segment_id int, content string, tag string, confidence double")


def test_label_windows(spark):
    smooth = lambda rows: [(r.tag, round(r.confidence, 4)) for r in labels.smooth(_rows(spark, [("x", t, p) for t, p in rows])).orderBy("segment_id").collect()]
    assert smooth([("a", 0.9), ("b", 0.6), ("a", 0.9)]) == [("a", 0.9), ("a", 0.54), ("a", 0.9)]
    assert smooth([("a", 0.9), ("b", 0.7), ("a", 0.9)])[1] == ("b", 0.7)
    assert smooth([("a", 0.5), ("b", 0.5), ("a", 0.5), ("b", 0.5)]) == [("a", 0.5), ("a", 0.45), ("b", 0.45), ("b", 0.5)]
    merged = labels.merge_same_tag(_rows(spark, [("未完", "a", 0.9), ("续。", "a", 0.8), ("新", "a", 0.7)])).orderBy("segment_id").collect()
    assert [(r.content, r.confidence) for r in merged] == [("未完\n续。", 0.8), ("新", 0.7)]


def test_assembly(spark):
    rows = _rows(spark, [("T", "标题", 1), ("A1", "摘要", 1), ("G", "研究目标", 1), ("T2", "标题", 1), ("A2", "摘要", 1), ("H", "研究目标", 1)])
    heads, rest = assemble.title_abstract(rows)
    assert tuple(heads.first()) == (1, "T", "A1\nA2")
    assert [(r.segment_id, r.tag, r.content) for r in rest.orderBy("segment_id").collect()] == [(1, "研究目标", "G"), (2, "其他", "T2"), (3, "研究目标", "H")]
    assert [r.tag for r in assemble.tag_numbers(rest).orderBy("segment_id").collect()] == ["研究目标_Segment1", "其他_Segment1", "研究目标_Segment2"]
    pages = ["甲乙 丙丁", "戊己庚辛"]
    for s, n in (("乙丙", 1), ("己 庚", 2), ("壬", None), (" ", None)):
        assert one(spark, lambda a, b: assemble.page_of(a, b), s, pages) == n
    assert one(spark, lambda a, b, c: assemble.leftover(a, b, c), "T 正文 A", "T", "A") == "正文"


def test_sources(spark):
    for text, want in (("|A|A|B|A|", "| A | B | A |"), ("|---|:--|", ""), ("| x  y |x y| z|", "| x y | z |"), ("|a|", "|a|"), ("| | |", "")):
        assert one(spark, documents.dedup_table_cells, text) == want
    buf = io.BytesIO()
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = "<w:tc><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:tc>"
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>{'para ' * 20}</w:t></w:r></w:p><w:tbl><w:tr>{cell.format('x')}{cell.format('')}{cell.format('y')}</w:tr></w:tbl></w:body></w:document>")
    files = [(1, "A.TXT", "汉字".encode("gbk")), (2, "b.docx", buf.getvalue()), (3, "c.exe", b"x"), (4, "d.docx", b"broken"), (5, "e.doc", b"\x00" + b"readable words " * 12)]
    df = spark.createDataFrame(files, "doc_id long, filename string, content binary")
    good, bad = documents.accepted(df)
    assert [r.doc_id for r in bad.collect()] == [3]
    got = {r.doc_id: r for r in documents.extract(good).collect()}
    assert got[1].text == "汉字" and got[2].text.endswith("x | y") and got[4].error and "readable words" in got[5].text
    assert documents.collect_layouts(lambda n, k: [1] * (k if n == 0 else 3)) == [1] * 203


def test_tasks(spark):
    ts = lambda s: None if s is None else f"2024-01-01 {s}"
    rows = [
        ("1", "processing", "11:00:00", "11:01:00", "11:55:00"), ("2", "processing", "11:00:00", "11:01:00", "11:49:00"), ("3", "processing", "11:00:00", "11:55:00", None),
        ("4", "processing", "11:00:00", None, None), ("5", "pending", "11:50:00", None, None), ("6", "pending", "11:49:59", None, None), ("7", "completed", "10:00:00", "10:01:00", "10:02:00"),
    ]
    df = spark.createDataFrame([(i, s, *map(ts, x)) for i, s, *x in rows], "task_id string, status string, c string, s string, l string")
    df = df.select("task_id", "status", *[F.col(a).cast("timestamp_ntz").alias(b) for a, b in (("c", "created_at"), ("s", "started_at"), ("l", "last_activity"))])
    assert sorted(r.task_id for r in tasks.stuck(df, "2024-01-01 12:00:00").collect()) == ["2", "4", "6"]
    assert tasks.recent(df, 0).count() == 1 and tasks.lookup(df, "3").count() == 1
    assert tasks.expired(df, "2024-01-02 10:30:00").count() == 1


def test_stream(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    spark.createDataFrame([("a", "pending"), ("b", "pending")], "task_id string, status string").write.json(str(src))
    q = tasks.process_stream(spark.readStream.schema("task_id string, status string").json(str(src)), lambda d: d.withColumn("status", F.lit("completed")), str(out), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert {(r.task_id, r.status) for r in spark.read.json(str(out)).select("task_id", "status").collect()} == {("a", "completed"), ("b", "completed")}


def test_parse_end_to_end(spark):
    rows = spark.createDataFrame([(1, "标题 甲\n\n" + "正文。" * 60, None, None), (2, None, "x.exe", b"1"), (3, None, None, None)], "doc_id long, text string, filename string, content binary")
    got = {r.doc_id: r for r in parse.parse(rows, parse.Options(chunk_size=100, overlap=10)).collect()}
    assert got[1].status == "success" and got[2].status == got[3].status == "error"
    for bad in ({"chunk_size": 10}, {"chunk_size": 60, "overlap": 60}, {"mode": "x"}):
        with pytest.raises(ValueError):
            parse.Options(**bad)
    for mode in ({"mode": "unified"}, {"segment_mode": "semantic"}):
        assert parse.parse(rows, parse.Options(**mode)).where("status = 'success'").count() == 1
    assert len(V.TAGS) == 13


def test_keywords_of_whole_segment():
    tag, words = V.TAG_KEYWORDS[0]
    assert labels.KeywordBackend().label(["。" * 3000 + words[0]]) == [(tag, 0.6)]


def test_parse_semantic_chunks(spark):
    rows = spark.createDataFrame([(1, "标题 甲\n\n" + "正文。" * 60, None, None)], "doc_id long, text string, filename string, content binary")
    options = parse.Options(chunk_size=100, chunk_method="semantic")
    got = parse.parse(rows, options, chunker=lambda c, n: [c[:40], c[40:]]).first()
    assert [40] in [[len(c.content) for c in s.chunks][:1] for s in got.segments if len(s.content) > 100]
    with pytest.raises(ValueError):
        parse.parse(rows, options)


def test_parse_keeps_documents_without_segments(spark):
    rows = spark.createDataFrame([(1, "Page 7", None, None), (2, "One sentence. Another one.", None, None), (3, " ", None, None)], "doc_id long, text string, filename string, content binary")
    got = {r.doc_id: r for r in parse.parse(rows).collect()}
    assert {i: (r.status, len(r.segments)) for i, r in got.items()} == {1: ("success", 0), 2: ("success", 1), 3: ("error", 0)}
    asked = parse.segments_of(rows.where("doc_id = 2").withColumn("text", F.lit("First one here。Second one here。" * 10)), parse.Options(segment_mode="semantic"), planner=lambda s: "no plan")
    assert asked.count() > 0
    broken = parse.segments_of(rows.where("doc_id = 2").withColumn("text", F.lit("First one here。Second one here。" * 10)), parse.Options(segment_mode="semantic"), planner=lambda s: 1 / 0)
    assert broken.count() > 0


def test_tasks_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "t", None), ("b", "u", "f.txt")], "task_id string, text string, filename string")
    made = tasks.submit(spark, rows, "2024-01-01 12:00:00")
    tasks.write_tasks(made, str(tmp_path / "tasks"))
    back = tasks.read_tasks(spark, str(tmp_path / "tasks"))
    assert {(r.task_id, r.status, r.text) for r in back.collect()} == {("a", "pending", "t"), ("b", "pending", "u")}
    swept = {r.task_id: r for r in tasks.sweep(back, "2024-01-01 12:10:01").collect()}
    assert all(r.status == "failed" and r.error_message for r in swept.values())
    assert tasks.sweep(back, "2024-01-01 12:10:00").where("status = 'failed'").count() == 0
    assert tasks.status_view(tasks.lookup(back, "a")).columns == ["task_id", "status", "progress", "created_at", "started_at", "completed_at", "error_message"]
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "x.txt").write_text("hello")
    assert [(r.filename, bytes(r.content)) for r in documents.read_files(spark, str(tmp_path / "files")).collect()] == [("x.txt", b"hello")]


def test_small_helpers(spark):
    assert one(spark, packing.numbered_prompt, ["x", "y"]) == "[1] x\n[2] y"
    assert "thirteen" not in labels.prompt("single", "T") and V.TAGS[0] in labels.prompt("single", "T")
    assert chunks.parse_chunk_texts('x [{"content": "a"}, {"content": "b"}]') == ["a", "b"]
    assert one(spark, lambda a: documents.suffix(a), "a/b.TXT") == ".txt"
    assert documents.salvage_text(("甲乙丙，" * 60).encode()) == "甲乙丙，" * 60


def _odd_documents(seed):
    """Texts of Chinese headings, lists with lines that continue them, page lines, blanks and long lines."""
    import random

    r = random.Random(seed)
    bits = ["一、研究背景", "1. 第一项", "（二）目标 说明", "(3) 子项", "- 要点", "第三条 内容", "第2页", "page 7", "- 12 -", "研究内容如下，", "而且结果很好。", "继续的一行没有结尾", "and so it goes", "The end.", "", "", "  "]
    bits += ["①圈", "a. 字母项", "x" * 40 + "。", "长句" * 30 + "；", "短！", "结束”"]
    out = ["\n".join(r.choice(bits) * r.choice([1, 1, 1, 4]) for _ in range(r.choice([1, 3, 8, 30, 120, 400]))) for _ in range(120)]
    item = lambda: r.choice(["1. ", "- ", "第一条", "(2)"]) + "项目内容" * r.randint(1, 60) + r.choice(["", "。", "；"])
    more = lambda: r.choice(["后续行", "延续"]) * r.randint(1, 40) + r.choice(["。", "", "x"])
    out += ["\n".join(item() if r.random() < 0.6 else more() for _ in range(r.choice([20, 60, 200]))) for _ in range(20)]
    heads = ["标题：甲项目", "摘要：" + "这是一段摘要。" * 20, "研究目标" + "是这样的。" * 40, "无关" * 300 + "。", "技术路线" * 120 + "。"]
    out += ["\n\n".join(r.choice(heads) * r.choice([1, 8, 30]) for _ in range(r.choice([2, 5, 9]))) for _ in range(60)]
    return [*out, "", "\n", "Page 7", "一句", "。。。", "\n\n\n", None]


@pytest.mark.parametrize("seed", [1, 2])
def test_folds_equal_their_sql_on_lists(spark, tmp_path, seed):
    import duckdb

    from quillstream.plans import queries

    spark.createDataFrame(list(enumerate(_odd_documents(seed))), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert any(r[0] for r in c.execute(f"SELECT max(len(g)) FROM ({queries._RULES}) HAVING max(len(g)) > 3").fetchall())
    for name in ("rule_segments", "presegment", "unified_blocks", "merge_neighbours", "join_broken_lines", "clean_text", "line_groups", "pack_sentences", "line_kinds", "list_line_ratio", "label_documents", "parse_documents"):
        got = queries.QUERIES[name](spark, str(tmp_path))
        cur = c.execute(queries.ORACLE[name])
        at = [[d[0] for d in cur.description].index(x) for x in got.columns]
        assert sorted(map(repr, (tuple(r[i] for i in at) for r in cur.fetchall()))) == sorted(repr(tuple(r)) for r in got.collect()), name
