"""The registered queries of the core library, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.functions import vocabulary as V
from quillstream.operators import assemble, chunks, labels, packing
from quillstream.plans import parse
from quillstream.sources import documents
from quillstream.streaming import tasks

SIZE, OVERLAP, NOW = 500, 50, "2024-01-31 00:00:00"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _docs(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", "text")


def _turns(spark, sf_dir) -> DataFrame:
    """Conversations as labelled segments: the role gives the tag, the length the confidence."""
    tag = F.when(F.col("role") == "system", V.TITLE).when(F.col("role") == "user", V.ABSTRACT).otherwise(V.TAGS[6])
    return _t(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("segment_id"), F.col("text").alias("content"), tag.alias("tag"), ((F.length("text") % 11) / F.lit(10.0)).alias("confidence")
    )


_TURNS = f"""SELECT conv_id AS doc_id, turn AS segment_id, text AS content,
  CASE role WHEN 'system' THEN '{V.TITLE}' WHEN 'user' THEN '{V.ABSTRACT}' ELSE '{V.TAGS[6]}' END AS tag, (length(text) % 11) / 10.0::DOUBLE AS confidence FROM conversations"""
_STRIP = lambda c: f"regexp_replace({c}, '^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g')"
_LIST = r"^(?:[0-9]+[.、]|[(（][0-9]+[)）]|[①-⑳]|第[一二三四五六七八九十百]+|[a-zA-Z][.、)）]|[一二三四五六七八九十]+[、.]|[-•·]\s+)"
_START = r"^[(（][一二三四五六七八九十]+[)）]\s*\S"
_PAGE = r"^(?:[-—]\s*[0-9]+\s*[-—]|[0-9]+|第\s*[0-9]+\s*页|(?i:page)\s*[0-9]+)$"
_UNIT = "[^。！？；\\n]*[。！？；\\n]|[^。！？；\\n]+"


def clean_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.clean_text(F.col("text")).alias("text"))


def join_broken_lines(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", packing.join_lines(F.col("text")).alias("text"))


def line_groups(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return packing.line_groups(lines).select("doc_id", "line_no", "group_no")


def list_line_ratio(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", packing.list_line_ratio(F.col("text")).alias("ratio"))


def line_kinds(spark, sf_dir):
    lines = _docs(spark, sf_dir).select(F.explode(F.split("text", "\n")).alias("line"))
    c = F.col("line")
    return lines.groupBy(T.list_type(c).alias("list_type"), T.is_terminated(c).alias("terminated"), T.is_page_marker(c).alias("page_marker")).agg(F.count(F.lit(1)).alias("n"))


def pack_sentences(spark, sf_dir):
    a = _docs(spark, sf_dir).select("doc_id", packing.pack_sentences(F.col("text"), 3000).alias("segments"))
    return packing.explode_segments(a)


def rule_segments(spark, sf_dir):
    return packing.explode_segments(_docs(spark, sf_dir).select("doc_id", packing.rule_segments(F.col("text")).alias("segments")))


def presegment(spark, sf_dir):
    return packing.explode_segments(_docs(spark, sf_dir).select("doc_id", packing.presegment(F.col("text")).alias("segments")))


def fallback_merge(spark, sf_dir):
    a = _docs(spark, sf_dir).select("doc_id", packing.fallback_merge(F.split("text", "\n")).alias("segments"))
    return packing.explode_segments(a)


def unified_blocks(spark, sf_dir):
    return packing.explode_segments(_docs(spark, sf_dir).select("doc_id", packing.unified_blocks(F.col("text")).alias("segments")))


def merge_neighbours(spark, sf_dir):
    return packing.explode_segments(_docs(spark, sf_dir).select("doc_id", packing.merge_neighbours(F.split("text", "\n")).alias("segments")))


def sliding_chunks(spark, sf_dir):
    s = _docs(spark, sf_dir).select("doc_id", F.lit(1).alias("segment_id"), F.lit(V.OTHER).alias("tag"), F.col("text").alias("content"))
    return chunks.number_chunks(chunks.chunk_segments(s, SIZE, OVERLAP)).select("doc_id", "chunk_id", "start_pos", "end_pos", "content")


def sliding_chunks_native(spark, sf_dir):
    a = _docs(spark, sf_dir).select("doc_id", F.posexplode(chunks.sliding_chunks(F.col("text"), SIZE, OVERLAP)).alias("k", "c"))
    return a.select("doc_id", (F.col("k") + 1).alias("chunk_id"), "c.start_pos", "c.end_pos")


def chunk_stats(spark, sf_dir):
    c = sliding_chunks(spark, sf_dir)
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.max("end_pos").alias("end_pos"))


def truncate_sentence(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.truncate_sentence(F.col("text"), 200).alias("text"))


def smooth_labels(spark, sf_dir):
    return labels.smooth(_turns(spark, sf_dir)).select("doc_id", "segment_id", "tag", F.round("confidence", 6).alias("confidence"))


def merge_same_tag(spark, sf_dir):
    return labels.merge_same_tag(_turns(spark, sf_dir)).select("doc_id", "segment_id", "content", "tag", "confidence")


def tag_numbering(spark, sf_dir):
    return assemble.tag_numbers(_turns(spark, sf_dir)).select("doc_id", "segment_id", "tag")


def renumber(spark, sf_dir):
    kept = _turns(spark, sf_dir).where(F.col("tag") != V.ABSTRACT)
    return assemble.renumber(kept).select("doc_id", "segment_id", "content")


def title_abstract(spark, sf_dir):
    return assemble.title_abstract(_turns(spark, sf_dir))[0]


def remaining_segments(spark, sf_dir):
    return assemble.title_abstract(_turns(spark, sf_dir))[1].select("doc_id", "segment_id", "content", "tag")


def page_lookup(spark, sf_dir):
    d = _docs(spark, sf_dir)
    n = F.length("text")
    pages = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / 1000).cast("int")), lambda i: F.substr("text", i * 1000 + 1, F.lit(1000)))
    return d.select("doc_id", assemble.page_of(F.substr("text", F.floor(n / 2).cast("int") + 1, F.lit(80)), pages).alias("page_idx"))


def layout_pages(spark, sf_dir):
    """Orders as layouts: the customer is the document, the order's day of the month its page."""
    o = _t(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "F", "head").otherwise("para").alias("type"),
        F.col("o_orderpriority").alias("text"), F.dayofmonth("o_orderdate").cast("string").alias("page_num"),
    )
    return assemble.page_numbers(o).select("doc_id", "page", "page_idx", "page_text")


def dedup_table_cells(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    bar = F.lit("|")
    row = F.concat(bar, "p_brand", bar, "p_brand", F.lit(" | "), "p_type", bar, F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.col("p_brand")), bar)
    text = F.concat(row, F.lit("\n|---|:--|\n"), F.col("p_name"), F.lit("\n|one|"))
    return p.select("p_partkey", documents.dedup_table_cells(text).alias("text"))


_WORDS = [w for _, ws in V.TAG_KEYWORDS for w in ws]


def fuzzy_tag(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    word = F.get(F.array(*map(F.lit, _WORDS)), (F.col("p_partkey") % len(_WORDS)).cast("int"))
    return p.select("p_partkey", T.fuzzy_tag(F.concat("p_name", word)).alias("tag"))


def _response():
    k = F.col("p_partkey")
    tag = F.get(F.array(*map(F.lit, V.TAGS)), (k % len(V.TAGS)).cast("int"))
    ok = F.concat(F.lit('x {"tag": "'), tag, F.lit('", "confidence": '), (k % 15 / F.lit(10.0)).cast("string"), F.lit("} y"))
    return F.when(k % 3 == 0, ok).when(k % 3 == 1, F.concat(F.lit("属于"), tag)).otherwise(F.lit("{no json}"))


def parse_label_json(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", labels.parse_single(_response()).alias("r"))
    return p.select("p_partkey", "r.tag", "r.confidence")


def parse_batch(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.when(k % 2 == 0, F.lit('[{"id":2,"tag":"标题","confidence":0.9},{"id":1,"tag":"研究目的"}]')).otherwise(F.lit("段落1：摘要"))
    p = _t(spark, sf_dir, "part").select("p_partkey", F.posexplode(labels.parse_batch(text, F.lit(2))).alias("k", "r"))
    return p.select("p_partkey", (F.col("k") + 1).alias("item"), "r.tag", "r.confidence")


def apply_plan(spark, sf_dir):
    a = _docs(spark, sf_dir).select("doc_id", labels.apply_plan(F.split("text", "\n"), F.lit('{"segments": [[2, 1], [2, 9999], [3]]}')).alias("segments"))
    return packing.explode_segments(a)


def label_documents(spark, sf_dir):
    """Rule segments with keyword labels, smoothed."""
    s = labels.smooth(labels.label_segments(rule_segments(spark, sf_dir)))
    return s.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def parse_documents(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", "text", F.lit(None).cast("string").alias("filename"), F.lit(None).cast("binary").alias("content"))
    out = parse.parse(rows, parse.Options(chunk_size=SIZE, overlap=OVERLAP))
    return out.select("doc_id", "status", "title", F.length("abstract").alias("abstract_chars"), F.size("segments").alias("n_segments"))


def decode_files(spark, sf_dir):
    files = _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".TXT")).alias("filename"), F.col("text").cast("binary").alias("content"))
    good, _ = documents.accepted(files)
    return documents.extract(good).select("doc_id", "text", "error")


def _events(spark, sf_dir):
    kind = F.col("event_type")
    status = F.when(kind == "signup", "pending").when(kind.isin("view", "click"), "processing").when(kind == "purchase", "completed").otherwise("failed")
    return _t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("task_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), status.alias("status"), F.col("value").alias("progress"), "event_id")


_EVENTS = """SELECT CAST(user_id AS VARCHAR) AS task_id, ts, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'processing'
  WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status, value AS progress, event_id FROM events"""


def _task_rows(spark, sf_dir):
    """Each event as a task of its own."""
    e = _events(spark, sf_dir)
    return e.select(
        F.col("event_id").cast("string").alias("task_id"), "status", F.col("ts").alias("created_at"), F.when(F.col("event_id") % 3 > 0, F.col("ts") + F.expr("INTERVAL 60 SECONDS")).alias("started_at"),
        F.when(F.col("event_id") % 5 == 0, F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("last_activity"),
    )


_TASKS = f"""SELECT CAST(event_id AS VARCHAR) AS task_id, status, ts AS created_at, CASE WHEN event_id % 3 > 0 THEN ts + INTERVAL 60 SECOND END AS started_at,
  CASE WHEN event_id % 5 = 0 THEN ts + INTERVAL 1 DAY END AS last_activity FROM ({_EVENTS})"""


def task_latest(spark, sf_dir):
    return tasks.latest(_events(spark, sf_dir)).select("task_id", "status", "n_events")


def task_stuck(spark, sf_dir):
    return tasks.stuck(_task_rows(spark, sf_dir), NOW).select("task_id", "status")


def task_expired(spark, sf_dir):
    return tasks.expired(_task_rows(spark, sf_dir), NOW).select("task_id")


def task_recent(spark, sf_dir):
    return tasks.recent(_task_rows(spark, sf_dir), 50).select("task_id", "status")


def metadata_tags(spark, sf_dir):
    return parse.tags(spark)


def metadata_health(spark, sf_dir):
    return parse.health(spark)


def metadata_formats(spark, sf_dir):
    return parse.formats(spark)


QUERIES = {
    f.__name__: f
    for f in (
        clean_text, join_broken_lines, line_groups, list_line_ratio, line_kinds, pack_sentences, rule_segments, presegment, fallback_merge, unified_blocks, merge_neighbours,
        sliding_chunks, sliding_chunks_native, chunk_stats, truncate_sentence, smooth_labels, merge_same_tag, tag_numbering, renumber, title_abstract, remaining_segments,
        page_lookup, layout_pages, dedup_table_cells, fuzzy_tag, parse_label_json, parse_batch, apply_plan, label_documents, parse_documents, decode_files,
        task_latest, task_stuck, task_expired, task_recent, metadata_tags, metadata_formats, metadata_health,
    )
}

_CLEAN = _STRIP(f"array_to_string(list_transform(string_split(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)), lambda x: {_STRIP('x')}), chr(10))")
_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents WHERE text IS NOT NULL"
_ENDS = r"[。！？；.!?…\"）)][\s\x0b]*$"
_facts = lambda lines: f"""SELECT *, {_STRIP('line')} AS s, regexp_matches(line, '\\S') AS full_, NOT regexp_matches(line, '{_ENDS}') AS open_ FROM ({lines}) WHERE NOT regexp_matches({_STRIP('line')}, '{_PAGE}')"""
_joins = lambda lines: f"""SELECT *, coalesce(lag(full_ AND open_) OVER w, false) AND full_ AND NOT regexp_matches(s, '{_LIST}') AND NOT regexp_matches(s, '{_START}') AS joins,
  row_number() OVER w AS rn FROM ({_facts(lines)}) WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)"""  # noqa: E731
_JOINS = _joins(_LINES)
_JOINED = "string_agg(CASE WHEN rn = 1 THEN '' WHEN joins THEN ' ' ELSE chr(10) END || CASE WHEN joins OR (full_ AND open_) THEN s ELSE line END, '' ORDER BY line_no)"
_SEG = lambda seg: f"SELECT doc_id, CAST(unnest(range(1, len(g) + 1)) AS INTEGER) AS segment_id, unnest(g) AS content FROM ({seg})"
_STATE = "CAST(struct_pack(done := [], cur := {cur}, unit := {unit}) AS STRUCT(done VARCHAR[], cur VARCHAR, unit VARCHAR))"


def _reduce(units: str, done: str, cur: str) -> str:
    """A fold over units in DuckDB: a is the state, x.unit the next unit."""
    one = _STATE.format(cur="''", unit="u")
    start = _STATE.format(cur="''", unit="''")
    return f"list_reduce(list_transform({units}, lambda u: {one}), lambda a, x: struct_pack(done := {done}, cur := {cur}, unit := ''), {start})"


_OVER = "length(a.cur) + length(x.unit) > {n}"
_PACK = _reduce(f"regexp_extract_all(text, '{_UNIT}')", f"CASE WHEN {_OVER.format(n=3000)} AND a.cur <> '' THEN list_append(a.done, {_STRIP('a.cur')}) ELSE a.done END", f"CASE WHEN {_OVER.format(n=3000)} THEN x.unit ELSE a.cur || x.unit END")
_MERGE = _reduce(
    "string_split(text, chr(10))", "CASE WHEN a.cur <> '' AND length(a.cur) + length(x.unit) >= 200 THEN list_append(a.done, a.cur) ELSE a.done END",
    f"CASE WHEN a.cur = '' OR length(a.cur) + length(x.unit) >= 200 THEN x.unit ELSE {_STRIP('a.cur || chr(10) || x.unit')} END",
)

_BLANK_LINE = "chr(10) || '\\s*' || chr(10)"
_BLOCKS = _reduce(
    f"string_split_regex(text, {_BLANK_LINE})", f"CASE WHEN length(a.cur) + length(x.unit) > {V.UNIFIED_BLOCK} AND a.cur <> '' THEN list_append(a.done, {_STRIP('a.cur')}) ELSE a.done END",
    f"CASE WHEN length(a.cur) + length(x.unit) > {V.UNIFIED_BLOCK} OR a.cur = '' THEN x.unit ELSE a.cur || chr(10) || chr(10) || x.unit END",
)
_FITS = f"length(a.cur) + length(x.unit) < {V.PRESEGMENT}"
_SENTENCES = f"""list_transform(list_filter(list_transform(regexp_extract_all(p, '{_UNIT}'), lambda u: struct_pack(body := {_STRIP("regexp_replace(u, '[。！？；\\n]$', '')")}, tail := regexp_extract(u, '[。！？；\\n]$'))),
  lambda u: u.body <> ''), lambda u: u.body || u.tail)"""
_SHORT_PACK = _reduce(_SENTENCES, f"CASE WHEN NOT ({_FITS}) AND a.cur <> '' THEN list_append(a.done, {_STRIP('a.cur')}) ELSE a.done END", f"CASE WHEN {_FITS} THEN a.cur || x.unit ELSE x.unit END")
_PARAGRAPHS = lambda texts: f"""SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS p_no FROM (SELECT doc_id,
  list_filter(list_transform(string_split_regex(text, {_BLANK_LINE}), lambda p: {_STRIP('p')}), lambda p: p <> '') AS ps FROM ({texts}))"""  # noqa: E731
_TAIL = lambda done: f"CASE WHEN regexp_matches(r.cur, '\\S') THEN list_append({done}, {_STRIP('r.cur')}) ELSE {done} END"
# Neighbours: the first unit is the fold's first state, as an empty unit is one too.
_ONE_TEXT = f"""NOT regexp_matches({_STRIP('a.cur')}, '[。！？；.!?]$') OR regexp_matches({_STRIP('x.cur')}, '^(?:[a-z]|{'|'.join(V.CONNECTIVES)})') OR (length(a.cur) < 100 AND length(x.cur) < 100)"""
_NEIGHBOURS = f"""list_reduce(list_transform(string_split(text, chr(10)), lambda u: CAST(struct_pack(done := [], cur := u) AS STRUCT(done VARCHAR[], cur VARCHAR))),
  lambda a, x: struct_pack(done := CASE WHEN {_ONE_TEXT} THEN a.done ELSE list_append(a.done, a.cur) END, cur := CASE WHEN {_ONE_TEXT} THEN a.cur || chr(10) || x.cur ELSE x.cur END))"""
_IS_ITEM = lambda c: f"regexp_matches({_STRIP(c)}, '{_LIST}')"
_MOST = V.LONG_PARAGRAPH
# A list's atoms: an item with the lines that continue it, up to a blank line; other lines alone.
_ATOMS = f"""SELECT doc_id, p_no, atom, string_agg(line, chr(10) ORDER BY i) AS t, bool_or(item) AS item FROM (SELECT *, sum(CASE WHEN item OR NOT full_ OR NOT coalesce(grows, false) THEN 1 ELSE 0 END) OVER w AS atom
  FROM (SELECT *, last_value(CASE WHEN item THEN true WHEN NOT full_ THEN false END IGNORE NULLS) OVER w AS grows FROM (SELECT *, {_IS_ITEM('line')} AS item, regexp_matches(line, '\\S') AS full_
    FROM (SELECT doc_id, p_no, unnest(string_split(p, chr(10))) AS line, unnest(range(len(string_split(p, chr(10))))) AS i FROM paras WHERE long_list)) WINDOW w AS (PARTITION BY doc_id, p_no ORDER BY i))
  WINDOW w AS (PARTITION BY doc_id, p_no ORDER BY i)) GROUP BY doc_id, p_no, atom"""
_FLUSH = f"a.size + length(x.cur) > {_MOST}"
_ATOM = "CAST(struct_pack(done := [], cur := {cur}, size := {size}, item := {item}) AS STRUCT(done VARCHAR[], cur VARCHAR, size BIGINT, item BOOLEAN))"
_LISTS = f"""SELECT doc_id, p_no, list_append(r.done, r.cur) AS g FROM (SELECT doc_id, p_no, list_reduce(list({_ATOM.format(cur='t', size='length(t) + CASE WHEN item THEN 0 ELSE 1 END', item='item')} ORDER BY atom),
  lambda a, x: struct_pack(done := CASE WHEN {_FLUSH} THEN list_append(a.done, a.cur) ELSE a.done END, cur := CASE WHEN {_FLUSH} THEN x.cur ELSE a.cur || chr(10) || x.cur END,
    size := CASE WHEN {_FLUSH} THEN 0 ELSE a.size END + x.size, item := x.item)) AS r FROM ({_ATOMS}) GROUP BY doc_id, p_no)"""
_LEAST = f"length(x.unit) < {V.SHORT_SEGMENT}"
_ROOM = f"length(a.cur) + length(x.unit) < {_MOST}"
_WITH_SHORT = _reduce(
    "segments", f"CASE WHEN a.cur <> '' AND NOT ({_LEAST}) AND NOT ({_ROOM}) THEN list_append(a.done, a.cur) ELSE a.done END",
    f"CASE WHEN a.cur = '' THEN x.unit WHEN {_LEAST} THEN {_STRIP('a.cur || chr(10) || x.unit')} WHEN {_ROOM} THEN a.cur || chr(10) || x.unit ELSE x.unit END",
)
_RULES = f"""WITH cleaned AS MATERIALIZED (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM (SELECT doc_id, {_CLEAN} AS text FROM documents WHERE text IS NOT NULL)),
  joined AS (SELECT doc_id, {_JOINED} AS text FROM ({_joins('FROM cleaned')}) GROUP BY doc_id),
  paras AS MATERIALIZED (SELECT *, length(p) > {_MOST} AND len(list_filter(string_split(p, chr(10)), lambda x: {_IS_ITEM('x')}))::DOUBLE / len(string_split(p, chr(10))) > 0.3 AS long_list FROM ({_PARAGRAPHS('FROM joined')})),
  parts AS (SELECT doc_id, p_no, [p] AS g FROM paras WHERE length(p) <= {_MOST} UNION ALL SELECT * FROM ({_LISTS})
    UNION ALL SELECT doc_id, p_no, {_TAIL('r.done')} AS g FROM (SELECT doc_id, p_no, {_PACK.replace('text', 'p')} AS r FROM paras WHERE length(p) > {_MOST} AND NOT long_list)),
  whole AS (SELECT doc_id, flatten(list(g ORDER BY p_no)) AS segments FROM parts GROUP BY doc_id)
  SELECT doc_id, CASE WHEN r.cur <> '' THEN list_append(r.done, r.cur) WHEN len(r.done) > 0 THEN r.done ELSE segments END AS g FROM (SELECT doc_id, segments, {_WITH_SHORT} AS r FROM whole)"""

_KEYWORDS = " ".join(f"WHEN {' OR '.join(f'contains(lower(content), {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{tag}'" for tag, ws in V.TAG_KEYWORDS)
# The keyword labels are all below the limit of smoothing.
_LABELLED = f"""SELECT doc_id, segment_id, content, CASE WHEN b = a THEN b ELSE tag END AS tag FROM (SELECT *, lag(tag) OVER w AS b, lead(tag) OVER w AS a
  FROM (SELECT *, CASE {_KEYWORDS} ELSE '{V.OTHER}' END AS tag FROM ({_SEG(_RULES)})) WINDOW w AS (PARTITION BY doc_id ORDER BY segment_id))"""
_PARSED = f"""WITH m AS MATERIALIZED (SELECT *, tag = '{V.ABSTRACT}' OR (tag = '{V.TITLE}' AND sum(CASE WHEN tag = '{V.TITLE}' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY segment_id) = 1) AS used FROM ({_LABELLED})),
  h AS (SELECT doc_id, arg_min({_STRIP('content')}, segment_id) FILTER (tag = '{V.TITLE}') AS title, string_agg({_STRIP('content')}, chr(10) ORDER BY segment_id) FILTER (tag = '{V.ABSTRACT}') AS abstract FROM m GROUP BY doc_id),
  k AS (SELECT doc_id, count(*) AS n, {_STRIP('string_agg(content, chr(10) ORDER BY segment_id)')} AS body FROM (SELECT *, sum(CASE WHEN used THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id) AS others FROM m) WHERE NOT used OR others = 0 GROUP BY doc_id),
  d AS (SELECT doc_id, coalesce(regexp_matches(text, '\\S'), false) AS ok FROM documents),
  c AS (SELECT *, regexp_extract(substr(body, 1, 500), '(?s)^.*[。！？；.!?]', 0) AS head FROM k)
  SELECT doc_id, CASE WHEN ok THEN 'success' ELSE 'error' END AS status, title,
    length(coalesce(abstract, CASE WHEN length(body) <= 500 THEN body WHEN length(head) - 1 > 250 THEN head ELSE substr(body, 1, 500) END))::INTEGER AS abstract_chars, coalesce(n, 0)::INTEGER AS n_segments
  FROM d LEFT JOIN h USING (doc_id) LEFT JOIN c USING (doc_id)"""

ORACLE = {
    "clean_text": f"SELECT doc_id, {_CLEAN} AS text FROM documents",
    "join_broken_lines": f"""SELECT doc_id, CASE WHEN bool_or(given) THEN coalesce({_JOINED}, '') END AS text
      FROM (SELECT doc_id, text IS NOT NULL AS given FROM documents) LEFT JOIN ({_JOINS}) USING (doc_id) GROUP BY doc_id""",
    "line_groups": f"SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS group_no FROM ({_JOINS})",
    "list_line_ratio": f"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches({_STRIP('x')}, '{_LIST}')))::DOUBLE / len(string_split(text, chr(10))) AS ratio FROM documents",
    "line_kinds": f"""SELECT CASE WHEN regexp_matches(s, '^[0-9]+[.、]') THEN 'num_dot' WHEN regexp_matches(s, '^[(（][0-9]+[)）]') THEN 'paren_num' WHEN regexp_matches(s, '^[①-⑳]') THEN 'circle'
      WHEN regexp_matches(s, '^第[一二三四五六七八九十百]+') THEN 'di_tiao' WHEN regexp_matches(s, '^[一二三四五六七八九十]+[、.]') THEN 'cn_num' ELSE 'other' END AS list_type,
      regexp_matches(line, '{_ENDS}') AS terminated, regexp_matches(s, '{_PAGE}') AS page_marker, count(*) AS n FROM (SELECT line, {_STRIP('line')} AS s FROM ({_LINES})) GROUP BY ALL""",
    "pack_sentences": _SEG(f"SELECT doc_id, CASE WHEN len(g) > 0 THEN g ELSE [text] END AS g FROM (SELECT doc_id, text, CASE WHEN regexp_matches(r.cur, '\\S') THEN list_append(r.done, {_STRIP('r.cur')}) ELSE r.done END AS g FROM (SELECT doc_id, text, {_PACK} AS r FROM documents))"),
    "fallback_merge": _SEG(f"SELECT doc_id, CASE WHEN r.cur <> '' THEN list_append(r.done, r.cur) WHEN len(r.done) > 0 THEN r.done ELSE string_split(text, chr(10)) END AS g FROM (SELECT doc_id, text, {_MERGE} AS r FROM documents)"),
    "rule_segments": _SEG(_RULES),
    "presegment": f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p_no, k) AS INTEGER) AS segment_id, content FROM (SELECT doc_id, p_no, unnest(g) AS content, unnest(range(len(g))) AS k
      FROM (SELECT doc_id, p_no, {_TAIL('r.done')} AS g FROM (SELECT doc_id, p_no, {_SHORT_PACK} AS r FROM ({_PARAGRAPHS('FROM documents')}))))""",
    "unified_blocks": _SEG(f"SELECT doc_id, CASE WHEN len(g) > 0 THEN g ELSE [text] END AS g FROM (SELECT doc_id, text, {_TAIL('r.done')} AS g FROM (SELECT doc_id, text, {_BLOCKS} AS r FROM documents))"),
    "merge_neighbours": _SEG(f"SELECT doc_id, list_append(r.done, r.cur) AS g FROM (SELECT doc_id, {_NEIGHBOURS} AS r FROM documents WHERE text IS NOT NULL)"),
    "sliding_chunks": f"""WITH RECURSIVE c AS (SELECT doc_id, text, 1 AS chunk_id, 0 AS start_pos, NULL::INTEGER AS end_pos FROM documents WHERE regexp_matches(text, '\\S')),
      e AS (SELECT doc_id, text, 0 AS chunk_id, 0 AS s, 0 AS e FROM c UNION ALL
        SELECT doc_id, text, chunk_id + 1, n, CASE WHEN n + {SIZE} >= length(text) THEN length(text) ELSE n + CASE WHEN k > 0 THEN {SIZE // 2} + k ELSE {SIZE} END END
        FROM (SELECT *, length(regexp_extract(substr(text, n + 1 + {SIZE // 2}, {SIZE - SIZE // 2}), '(?s)^.*[。！？；.!?\\n]', 0)) AS k FROM (SELECT *, CASE WHEN chunk_id = 0 THEN 0 ELSE e - {OVERLAP} END AS n FROM e WHERE chunk_id = 0 OR e < length(text))))
      SELECT doc_id, CAST(chunk_id AS INTEGER) AS chunk_id, CAST(s AS INTEGER) AS start_pos, CAST(e AS INTEGER) AS end_pos, CASE WHEN length(text) <= {SIZE} THEN text ELSE {_STRIP('substr(text, s + 1, e - s)')} END AS content FROM e WHERE chunk_id > 0""",
    "truncate_sentence": "SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN length(k) - 1 > 100 THEN k ELSE substr(text, 1, 200) END AS text FROM (SELECT doc_id, text, regexp_extract(substr(text, 1, 200), '(?s)^.*[。！？；.!?]', 0) AS k FROM documents)",
    "smooth_labels": f"""SELECT doc_id, segment_id, CASE WHEN t THEN b ELSE tag END AS tag, round(CASE WHEN t THEN confidence * 0.9::DOUBLE ELSE confidence END, 6) AS confidence FROM (SELECT *, coalesce(confidence < 0.7::DOUBLE AND b = a AND b <> tag, false) AS t
      FROM (SELECT *, lag(tag) OVER w AS b, lead(tag) OVER w AS a FROM ({_TURNS}) WINDOW w AS (PARTITION BY doc_id ORDER BY segment_id)))""",
    "merge_same_tag": f"""SELECT doc_id, g AS segment_id, string_agg(content, chr(10) ORDER BY segment_id) AS content, first(tag) AS tag, min(confidence) AS confidence FROM (SELECT *, CAST(sum(st) OVER (PARTITION BY doc_id ORDER BY segment_id) AS BIGINT) AS g
      FROM (SELECT *, CASE WHEN lag(tag) OVER w = tag AND NOT regexp_matches(lag(content) OVER w, '[。！？；.!?…][\\s\\x0b]*$') THEN 0 ELSE 1 END AS st FROM ({_TURNS}) WINDOW w AS (PARTITION BY doc_id ORDER BY segment_id))) GROUP BY doc_id, g""",
    "tag_numbering": f"SELECT doc_id, segment_id, tag || '_Segment' || row_number() OVER (PARTITION BY doc_id, tag ORDER BY segment_id) AS tag FROM ({_TURNS})",
    "renumber": f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY segment_id) AS INTEGER) AS segment_id, content FROM ({_TURNS}) WHERE tag <> '{V.ABSTRACT}'",
    "title_abstract": f"""SELECT doc_id, arg_min({_STRIP('content')}, segment_id) FILTER (tag = '{V.TITLE}') AS title, string_agg({_STRIP('content')}, chr(10) ORDER BY segment_id) FILTER (tag = '{V.ABSTRACT}') AS abstract FROM ({_TURNS}) GROUP BY doc_id""",
    "remaining_segments": f"""WITH m AS (SELECT *, tag = '{V.ABSTRACT}' OR (tag = '{V.TITLE}' AND sum(CASE WHEN tag = '{V.TITLE}' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY segment_id) = 1) AS used FROM ({_TURNS})),
      k AS (SELECT *, sum(CASE WHEN used THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id) AS n FROM m)
      SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY segment_id) AS INTEGER) AS segment_id, content, CASE WHEN used OR tag = '{V.TITLE}' THEN '{V.OTHER}' ELSE tag END AS tag FROM k WHERE NOT used OR n = 0""",
    "page_lookup": """WITH d AS (SELECT doc_id, regexp_replace(substr(text, CAST(floor(length(text) / 2) AS INTEGER) + 1, 80), '\\s', '', 'g') AS s, unnest(range(CAST(floor((greatest(length(text), 1) - 1) / 1000) AS INTEGER) + 1)) AS i, text FROM documents),
      p AS (SELECT doc_id, i, s, regexp_replace(substr(text, i * 1000 + 1, 1000), '\\s', '', 'g') AS t FROM d)
      SELECT doc_id, CAST(coalesce(min(CASE WHEN s <> '' AND contains(t, substr(s, 1, 60)) THEN i + 1 END), min(CASE WHEN s <> '' AND contains(t, substr(s, 1, 30)) THEN i + 1 END)) AS INTEGER) AS page_idx FROM p GROUP BY doc_id""",
    "layout_pages": f"""SELECT doc_id, page, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY page) AS INTEGER) AS page_idx, page_text FROM (SELECT o_custkey AS doc_id, CAST(day(o_orderdate) AS INTEGER) AS page,
      string_agg({_STRIP('o_orderpriority')}, chr(10) || chr(10) ORDER BY o_orderkey) AS page_text FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2)""",
    "dedup_table_cells": f"""SELECT p_partkey, '| ' || p_brand || ' | ' || p_type || CASE WHEN p_size % 2 = 0 THEN '' ELSE ' | ' || p_brand END || ' |' || chr(10) || p_name || chr(10) || '|one|' AS text FROM part""",
    "fuzzy_tag": "SELECT p_partkey, CASE " + " ".join(f"WHEN {' OR '.join(f'contains(t, {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{tag}'" for tag, ws in V.TAG_KEYWORDS) + f" ELSE '{V.OTHER}' END AS tag FROM (SELECT p_partkey, lower(p_name || {_WORDS}[p_partkey % {len(_WORDS)} + 1]) AS t FROM part)",
    "parse_label_json": f"""SELECT p_partkey, CASE p_partkey % 3 WHEN 2 THEN '{V.OTHER}' ELSE {V.TAGS}[p_partkey % 13 + 1] END AS tag,
      CASE p_partkey % 3 WHEN 0 THEN least(p_partkey % 15 / 10.0::DOUBLE, 1.0::DOUBLE) WHEN 1 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM part""",
    "parse_batch": f"""SELECT p_partkey, CAST(i AS INTEGER) AS item, CASE WHEN p_partkey % 2 = 0 THEN CASE i WHEN 1 THEN '{V.TITLE}' ELSE '{V.TAGS[6]}' END ELSE CASE i WHEN 1 THEN '{V.ABSTRACT}' ELSE '{V.OTHER}' END END AS tag,
      CASE WHEN p_partkey % 2 = 0 THEN CASE i WHEN 1 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END ELSE CASE i WHEN 1 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END END AS confidence FROM part, (SELECT unnest([1, 2]) AS i)""",
    "apply_plan": _SEG("SELECT doc_id, CASE WHEN len(l) >= 2 THEN list_concat([l[2] || chr(10) || l[1]], l[3:]) ELSE l END AS g FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"),
    "label_documents": f"SELECT tag, count(*) AS n FROM ({_LABELLED}) GROUP BY tag",
    "parse_documents": _PARSED,
    "decode_files": "SELECT doc_id, text, NULL::VARCHAR AS error FROM documents WHERE text <> ''",
    "task_latest": f"""SELECT task_id, coalesce(arg_min(status, (ts, status)) FILTER (status IN ('completed', 'failed')), arg_max(status, (ts, status))) AS status, count(*) AS n_events FROM ({_EVENTS}) GROUP BY task_id""",
    "task_stuck": f"""SELECT task_id, status FROM ({_TASKS}) WHERE (status = 'processing' AND (coalesce(last_activity, started_at) IS NULL OR TIMESTAMP '{NOW}' - INTERVAL 600 SECOND > coalesce(last_activity, started_at)))
      OR (status = 'pending' AND TIMESTAMP '{NOW}' - INTERVAL 600 SECOND > created_at)""",
    "task_expired": f"SELECT task_id FROM ({_TASKS}) WHERE created_at < TIMESTAMP '{NOW}' - INTERVAL 24 HOUR",
    "task_recent": f"SELECT task_id, status FROM ({_TASKS}) ORDER BY created_at DESC, task_id LIMIT 50",
    "metadata_tags": f"SELECT CAST(i AS INTEGER) AS tag_order, {V.TAGS}[i] AS tag, '{V.VERSION}' AS version FROM (SELECT unnest(range(1, 14)) AS i)",
    "metadata_health": f"SELECT 'healthy' AS status, '{V.SERVICE_VERSION}' AS version, 'quillstream' AS service",
    "metadata_formats": f"SELECT unnest({V.FORMATS}) AS suffix, {V.MAX_UPLOAD_MB} AS max_mb",
}
ORACLE["sliding_chunks_native"] = f"SELECT doc_id, chunk_id, start_pos, end_pos FROM ({ORACLE['sliding_chunks']})"
ORACLE["chunk_stats"] = f"SELECT doc_id, count(*) AS n_chunks, max(end_pos) AS end_pos FROM ({ORACLE['sliding_chunks']}) GROUP BY doc_id"
