"""The training-data operators against plain versions, the libraries, exact round trips and held-out labels."""

import collections
import itertools
import json
import math
import random
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from quillstream.llm import decontaminate, html_text, ngram_join, outliers, quality, queries, sentence_pieces, token_binary, token_counts, toxicity, warc
from quillstream.llm.common import fold_words, materialize, table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, keys string"
ODD = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "alpha beta gamma delta epsilon zeta"), (5, "x" * 70_000), (6, " \n\t "), (7, "a\x00b é日本 " * 5000)]


def odd(spark, rows=ODD):
    """Nulls, empty and very long texts, repeated rows, extra columns with clashing names."""
    return spark.createDataFrame([(i, t, None if i == 2 else "en", "s", None, 1.0, "k") for i, t in rows], DOCS)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string, size long")


@pytest.fixture(scope="module")
def labelled(sf):
    return duckdb.sql(f"SELECT doc_id, text, quality, toxic FROM '{sf}/documents.parquet' JOIN '{sf}/labels.parquet' USING (doc_id) ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, sf).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


def test_token_counts(spark):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    c, g = token_counts.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json")), random.Random(1)
    parts = ["a", " ", "  ", "\n", "'s", "'ll", " '", "<|endoftext|>", "<|end", "é", "☃", "12", "!", "\t", "the", "\xa0", "日本"]
    for _ in range(300):
        s = "".join(g.choice(parts) for _ in range(g.randint(0, 12)))
        assert c.prefix_counts(s) == [len(lib.encode(s[:k], add_special_tokens=False).ids) for k in range(len(s) + 1)]
        assert c.count(s) == c.prefix_counts(s)[-1]
    got = token_counts.token_counts(odd(spark), public_tokenizers.path("byte_bpe_50k.json")).collect()
    want = sorted((len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for _, t in ODD)
    assert sorted((r.n_bytes, r.n_tokens) for r in got) == want
    rows = [(1, "the quick  brown fox's <|endoftext|> é☃ 日本\n\n 12"), (2, None), (3, ""), (4, "\xa0" * 4000)]
    counted, _ = materialize(token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json"), keep_text=True), "counted")
    text = rows[0][1]
    every = [len(lib.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
    for budget in (0, 1, 3, 7, 12, 10_000):
        cut = {r.doc_id: (r.n_chars, r.text) for r in token_counts.truncations(counted, budget).collect()}
        best = max(k for k, n in enumerate(every) if n <= budget)
        assert cut[1] == (best, text[:best]) and cut[2] == cut[3] == (0, "")
    for k in (0, 4, 13, 99):
        assert {r.doc_id: r.n_tokens for r in token_counts.prefix_tokens(counted, k).collect()}[1] == every[min(k, len(text))]
    counts = [0, 200, 3]
    assert token_counts.packed(counts) is None and token_counts.counts_of(np.diff(np.array(counts, "<i4")).tobytes(), 2).tolist() == counts
    assert token_counts.token_counts(odd(spark, []), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_token_files(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = token_binary.token_files(odd(spark), path, 2).orderBy("start").collect()
    at = 0
    for r, (i, t) in zip(got, sorted(ODD, key=lambda x: -1 if x[0] is None else x[0]), strict=True):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    folder = token_binary.new_path(spark, "tokens")
    token_binary.write_token_files(odd(spark), path, 2, folder)
    found = token_binary.lookup_documents(spark, folder, [3, 5, 12]).collect()
    assert sorted((r.doc_id, r.ids) for r in found) == sorted((i, [*lib.encode(t, add_special_tokens=False).ids, 2]) for i, t in ODD if i in (3, 5))
    files = [r.path for r in token_binary.read_files(spark, folder).select("path").collect()]
    held = [token_binary.open_file(spark, f) for f in files]
    assert sorted(x for r in held for x in r.ids.tolist()) == sorted(token_binary.NO_ID if i is None else i for i, _ in ODD)
    assert [x for r in held for x in r.lookup(2)] == [np.array([2], "<u4").tobytes()]
    data = token_binary.pack_file([4, 9], [b"\1\0\0\0", b"\2\0\0\0" * 3])
    assert token_binary.FileReader(data).lookup(9) == [b"\2\0\0\0" * 3]
    with pytest.raises(ValueError):
        token_binary.FileReader(data[:30] + b"!" + data[31:]).lookup(4)


def test_words_of_token_files():
    g, e = random.Random(8), token_binary.ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"))
    parts = [*"aB 12!.,_-", "  ", "\n", "'s", "'LL", "<|endoftext|>", "<|end", "e\u0301", "É", "☃", "...", "\t", "\xa0", "日本", "İ", "ΑΣ", "ß", "\xad", "\x1c", "ª", "½", "K", "ŉ"]
    texts = ["".join(g.choice(parts) for _ in range(g.randint(0, 9))) for _ in range(20_000)]
    assert e.pieces is not None and e.encode(texts) == e._library(texts)


def test_capitals_of_token_files(tmp_path):
    """A special string in capitals is plain text, and a vocabulary that keeps capitals gets them."""
    path = public_tokenizers.path("word_bpe_49k.json")
    spec = json.load(open(path, encoding="utf-8"))
    spec["normalizer"]["normalizers"].pop()
    (tmp_path / "cased.json").write_text(json.dumps(spec))
    spec["normalizer"]["normalizers"].append({"type": "Lowercase"})
    spec["added_tokens"].append(spec["added_tokens"][0] | {"id": 49408, "content": "[sep]"})
    (tmp_path / "sep.json").write_text(json.dumps(spec))
    texts = ["a <|ENDOFTEXT|> B", "A<|EndOfText|>", "É <|ENDOFTEXT|> b", "x<|endoftext|>Y", "Big small BIG", "a[sep]B [sep] [SEP]"]
    for file in (path, str(tmp_path / "cased.json"), str(tmp_path / "sep.json")):
        e = token_binary.ChunkEncoder(file)
        assert e.by_word and e.encode(texts) == e._library(texts)


def test_words_are_remembered():
    """Of more words than are kept the rare ones go, within a text too, and ids stay the library's."""
    e, asked = token_binary.ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"), keep=200), collections.Counter()
    direct = e._direct
    e._direct = lambda w: asked.update([w]) or direct(w)
    letters = "abcdefghijklmnopqrstuvwxyz"
    common = ["".join(x) for x in itertools.product("aeiou", letters[:10])]
    rare = ["".join(x) for x in itertools.product("xyz", letters, letters)]
    texts = [" ".join([*common, *rare[at : at + 100], rare[at] + ",!", "b" * 70]) for at in range(0, 2000, 100)] + [" ".join(rare)]
    assert e.encode(texts) == e._library(texts)
    assert {asked[w] for w in common} == {1}
    assert asked[",!"] == 1 and len(e.words) <= 200 and len(e.words.older) <= 200 and "b" * 70 not in e.words
    e.words.forget()
    assert not e.words and not e.words.older and e.encode(texts[:2]) == e._library(texts[:2])


def test_token_file_by_ranges():
    data = token_binary.pack_file([4, 9], [bytes(range(256)) * 40, b"\2\0\0\0" * 3])
    asked = []
    reader = token_binary.FileReader(lambda a, b: asked.append((a, b)) or data[a:b], len(data))
    assert reader.lookup(9) == [b"\2\0\0\0" * 3]
    first = (int(reader.offsets[1]), int(reader.offsets[2]))  # the frame of document 4
    assert all(b <= first[0] or a >= first[1] for a, b in asked)


def test_warc(spark):
    rows = [(3, "u", "<p>x</p>", "t", 1), (1, None, "<p>x</p>", None, 2), (2, "v\r\nw", None, "t", 3), (4, "w", "", "t", 4), (None, "z", "<p>é</p>", "t", 5)]
    got = {r.page_id: r for r in warc.archives(pages(spark, rows)).collect()}
    assert (got[1].record_type, got[3].record_type, got[3].refers_to, got[4].refers_to) == ("response", "revisit", 1, 2)
    assert got[None].payload_bytes == 9 and got[1].html == "<p>x</p>" and got[2].payload_digest == warc.sha1_base32(b"")
    assert warc.archives(pages(spark, [])).count() == 0
    good = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<a>"), ("WARC-Date", "d")], b"abc")
    assert warc.parse_record(good)[1] == b"abc"
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"Length: 3", b"Length: 4")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def test_warc_null_ids(spark):
    rows = [(None, u, h, "t", 1) for u, h in [("a", "<p>x</p>"), ("b", "<p>x</p>"), ("b", "<p>x</p>"), ("c", "<p>y</p>"), ("d", "<p>z</p>")]] + [(7, "e", "<p>z</p>", "t", 1)]
    got = collections.Counter((r.page_id, r.record_type, r.refers_to, r.html) for r in warc.archives(pages(spark, rows)).collect())
    assert got == {(None, "response", None, "<p>x</p>"): 1, (None, "revisit", None, None): 2, (None, "response", None, "<p>y</p>"): 1, (7, "response", None, "<p>z</p>"): 1, (None, "revisit", 7, None): 1}


def test_decontaminate(spark):
    docs = spark.createDataFrame([(1, "A b c d."), (2, None), (3, "x b C y b c"), (3, "q"), (None, "b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(10, "b C"), (2, "B c"), (2, "b c"), (5, None), (6, "--"), (7, " ".join(map(str, range(20))))], "item_id long, text string")
    for words in (2_000_000, 2):  # one block, and several
        got = sorted(decontaminate.verdicts(decontaminate.decontaminate(docs, bench, block_words=words)).collect(), key=lambda r: (r.doc_id or 0, r.n_words))
        assert [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got] == [(None, 2, 2, 2, True), (1, 4, 2, 2, True), (2, 0, 0, 0, False), (3, 1, 0, 0, False), (3, 6, 4, 2, True)]
        assert got[0].items_sha256 == decontaminate.items_digest([10, 2]) and got[2].items_sha256 == decontaminate.items_digest([])
    index = decontaminate.build_index(docs)
    assert sorted(map(tuple, decontaminate.phrase_matches(index, [(1, "b c")]).where("doc_id = 3").collect())) == [(1, 3, 1), (1, 3, 4)]
    assert decontaminate.phrase_matches(index, [(1, "a d")], slop=3).count() == 1 and decontaminate.phrase_matches(index, [(1, "a d")], slop=2).count() == 0
    assert {r.doc_id for r in decontaminate.keep_uncontaminated(docs, bench).collect()} == {2, 3}
    assert decontaminate.decontaminate(odd(spark, []), bench).count() == 0 and decontaminate.decontaminate(odd(spark), bench).count() == len(ODD)


def test_decontaminate_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SEGMENT_BYTES", 1)  # a segment a document
    docs = spark.createDataFrame([(k // 2, f"b c {k}") for k in range(160)], "doc_id long, text string").repartition(80)
    bench = spark.createDataFrame([(10, "b c"), (11, "b c 7")], "item_id long, text string")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert decontaminate.build_index(docs).rdd.getNumPartitions() > 64
        for words in (2_000_000, 2):  # one block, and several
            got = decontaminate.decontaminate(docs, bench, block_words=words).collect()
            assert sorted(r.doc_id for r in got) == sorted(k // 2 for k in range(160))
            assert sorted(len(r["items"]) for r in got) == [1] * 159 + [2]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_ngram_join(spark):
    g = random.Random(4)
    base = [[f"w{g.randrange(5000)}" for _ in range(60)] for _ in range(6)]
    rows = []
    for k in range(90):
        w = list(base[k % 6])
        for _ in range(g.choice([0, 0, 1, 2, 6])):
            w[g.randrange(60)] = f"z{g.randrange(10_000)}"
        rows.append((k + 10, " ".join(w)))
    rows += [(1, None), (2, ""), (3, "one two"), (4, "One, two")]
    got = {r.doc_id: r for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := fold_words(t)) else set() for i, t in rows}
    near = collections.defaultdict(set)
    for a in sets:
        for b in sets:
            if a != b and sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                near[a].add(b)
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            todo = [y for x in todo for y in near[x] if y not in seen and not seen.add(y)]
        assert (got[i].class_id, got[i].n_links) == (min(seen), len(near[i]))
    kept = ngram_join.keep_one(odd(spark))
    assert kept.columns == odd(spark).columns and kept.count() == len(ODD) - 1
    assert ngram_join.ngram_join(odd(spark, [])).count() == 0
    b, r = ngram_join.choose_bands(0.8, 0.9999)
    assert 1 - (1 - 0.8**r) ** b >= 0.9999


def test_ngram_join_repeated_ids(spark):
    g = random.Random(9)
    text = lambda: " ".join(f"w{g.randrange(5000)}" for _ in range(60))
    first, second = {k: text() for k in range(12)}, {k: text() for k in range(12)}
    rows = [(k, t[k]) for t in (first, second) for k in t]
    rows += [(100 * s + k, t[k] + " end") for s, t in ((1, first), (2, second)) for k in t]  # linked, not equal
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in ngram_join.ngram_join(docs).collect()}
    key = lambda t: xxhash.xxh3_128_digest(ngram_join.grams(t).tobytes())
    for k in range(12):
        near, far = (100 + k, 200 + k) if key(first[k]) < key(second[k]) else (200 + k, 100 + k)
        assert [(got[i].class_id, got[i].n_links) for i in (k, near, far)] == [(k, 1), (k, 1), (far, 0)]
    twin = text()
    more = spark.createDataFrame([(0, first[0]), (500, twin), (500, twin + " end"), (None, twin)], "doc_id long, text string")
    kept = sorted(map(tuple, ngram_join.keep_one(docs.union(more)).collect()), key=repr)
    assert len(kept) == 26 and len({i for i, _ in kept} - {None, 500}) == 12
    assert {r for r in kept if r[0] not in (None, 500)} == {r for r in rows if r[0] < 100} and (None, twin) in kept


def test_ngram_join_chains(spark):
    """Chains of texts, each linked to its neighbours alone."""
    g = random.Random(21)
    rows = []
    for chain in range(4):
        words = [f"c{chain}w{g.randrange(9000)}" for _ in range(80)]
        for k in range(9):
            words[k * 7 % 80] = f"c{chain}n{k}"
            rows.append((len(rows), " ".join(words)))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows if (w := t.split())}
    near = {a: {b for b in sets if b != a and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])} for a in sets}
    assert any(len(x) == 1 for x in near.values()) and max(map(len, near.values())) < 9
    for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        seen, todo = {r.doc_id}, [r.doc_id]
        while todo:
            todo = [y for x in todo for y in near[x] if y not in seen and not seen.add(y)]
        assert (r.class_id, r.n_links) == (min(seen), len(near[r.doc_id]))


def test_groups_of_buckets(spark, monkeypatch):
    """All texts share a bucket: what is linked gets into one group, unlike texts stay apart while rounds last."""
    g = np.random.default_rng(4)
    base = [np.unique(g.integers(0, 2**60, 100).astype(np.uint64)) for _ in range(3)]
    sets = [np.unique(np.concatenate([x[k:], g.integers(0, 2**60, k).astype(np.uint64)])) for x in base for k in (0, 8, 25, 30)]
    rows = spark.createDataFrame([(k, s.tobytes()) for k, s in enumerate(sets)], "rep long, grams binary")
    buckets = spark.createDataFrame([(1, k) for k in range(len(sets))] + [(2, 0), (2, 11), (3, 5)], "key long, rep long")
    like = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    for rounds in (1, 50):
        monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
        of = {r.node: r.component for r in ngram_join.connected_components(ngram_join._group_edges(buckets, rows, 0.8)).collect()}
        for a in range(len(sets)):
            for b in range(a):
                if like(sets[a], sets[b]) >= 0.8:
                    assert of[a] == of[b]
        if rounds == 50:
            assert len({of.get(k, k) for k in (0, 4, 8)}) == 3


def test_link_matrix_matches_sets():
    g = np.random.default_rng(0)
    sets = [np.unique(g.integers(0, 60, 40).astype(np.uint64)) for _ in range(12)]
    m = ngram_join._link_matrix(sets[:5], sets[5:], 0.4)
    assert all(m[i, j] == (len(np.intersect1d(a, b)) >= 0.4 * len(np.union1d(a, b))) for i, a in enumerate(sets[:5]) for j, b in enumerate(sets[5:]))


def test_sentence_pieces(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib, p, g = sentencepiece.SentencePieceProcessor(model_file=path), sentence_pieces.Pieces(path), random.Random(2)
    parts = [*"theingstrao", "tion", "the", "☃", "日", "q", " ", "\n", "é"]
    for k in range(200):
        s = "".join(g.choice(parts[: 13 if k % 2 else None]) for _ in range(g.randint(0, 200)))
        assert p.encode(s, chunk=g.choice([20, 33, 64]), reach=1) == lib.encode(s)
        assert p.decode(lib.encode(s)) == lib.decode(lib.encode(s))
    # The longest tokens may end at a border that isn't free; words come back after they were forgotten.
    few = sentence_pieces.Pieces(path, keep=8)
    for n in range(1, 90):
        for s in ("." * n, "_" * n + "." * n, "a" + "=" * n + "\n" + " " * n + "the."):
            assert all(few.encode(s, chunk=c, reach=r) == lib.encode(s) for c in (40, 41) for r in (0, 1, 5))
    assert p.encode("-" * 40_000) == lib.encode("-" * 40_000)
    got = sentence_pieces.encode(odd(spark), path).collect()
    assert sorted((r.ids for r in got)) == sorted(lib.encode(t or "") for _, t in ODD) and all(r.round_trip for r in got)
    assert sentence_pieces.encode(odd(spark, []), path).count() == 0
    back = sentence_pieces.decode(sentence_pieces.encode(odd(spark), path), path)
    assert sorted(r.text for r in back.collect()) == sorted(t or "" for _, t in ODD)


def test_html(spark):
    model, wrong, total = html_text.trained(), 0, 0
    for page, y in html_text.labelled_pages(60, seed=77):
        got = model.decode([b.features for b in html_text.blocks(page)])
        wrong, total = wrong + sum(a != b for a, b in zip(got, y)), total + len(y)
    assert wrong < 0.02 * total
    html = "<html><head><title>t</title></head><body><nav><ul><li><a href=/x>Home</a></li></ul></nav><article><h1>Head &amp; line</h1><p>One <b>bo</b>ld\n sentence here.<p>Second one, a longer sentence.</article><footer>&copy; me</footer>"
    got = {r.page_id: r for r in html_text.extract(pages(spark, [(1, "u", html, None, 1), (2, None, None, "x", 2), (3, "v", "", "x", 3)])).collect()}
    assert got[1].text == "Head & line One bold sentence here. Second one, a longer sentence." and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == ""
    assert html_text.extract(pages(spark, [])).count() == 0


def test_html_odd_pages():
    model = html_text.trained()
    text = lambda h: html_text.main_text(h, model)
    one = "This is the one long sentence of a short article without any heading above it."
    two = "A second paragraph follows the first one and says a little more about it."
    for h in (f"<article><p>{one}</p></article>", f"<body><p>{one}</p></body>", f"<html><body><div>{one}</div></body></html>", one):
        assert text(h) == one
    assert text(f"<p>{one}</p><p>{two}</p>") == f"{one} {two}"
    for h in (f"""<h1>Head</h1><p>{one}</p><p><a title="it's>{two}</a></p>""", f"<h1>Head</h1><p>{one}</p><p><a it's href=/x/>{two}</a></p>", f"""<h1>Head</h1><p>{one}</p><p title='a > "b"'>{two}</p>"""):
        assert text(h) == f"Head {one} {two}"
    assert [b.text for b in html_text.blocks("<div class=ad/>buy<p>now</div>x")] == ["buy", "now", "x"]
    ad = next(b for b in html_text.blocks("<div class=ad/>buy</div>"))
    assert "in:ad" in ad.features
    assert [b.text for b in html_text.blocks("a<script>1 < 2 </p></script>b<style>x")] == ["a b"]
    assert [b.text for b in html_text.blocks("1 < 2 <!-- x --> and <!doctype x>3 &lt; 4 <b")] == ["1 < 2 and 3 < 4 <b"]
    for junk in ("<script", "<a b='", '<a b="', "<", "</", "<!--", "<svg>", "&#", "<p>"):
        began = time.process_time()
        html_text.blocks(junk * 20_000)
        assert time.process_time() - began < 10


def test_crf_matches_enumeration():
    g = np.random.default_rng(3)
    for n in (1, 2, 5, 7):
        step, names = g.normal(size=(2, 2)), [f"f{k}" for k in range(4)]
        crf = html_text.Crf(dict(zip(names, g.normal(size=4).tolist())), step)
        xs = [[f for f in names if g.random() < 0.5] for _ in range(n)]
        e = [sum(crf.weights[f] for f in fs) for fs in xs]
        score = {y: sum(a for a, k in zip(e, y) if k) + sum(step[a, b] for a, b in zip(y, y[1:])) for y in itertools.product((0, 1), repeat=n)}
        assert tuple(crf.decode(xs)) == max(score, key=score.get)
        total = sum(map(math.exp, score.values()))
        node, pair = html_text.Crf._marginals(np.array([e]), step, np.ones((1, n), bool))
        for k in range(n):
            assert abs(node[0, k] - sum(math.exp(v) for y, v in score.items() if y[k]) / total) < 1e-9
        want = np.zeros((2, 2))
        for y, v in score.items():
            for a, b in zip(y, y[1:]):
                want[a, b] += math.exp(v) / total
        assert np.allclose(pair[0], want)


def test_base_counts():
    g = random.Random(3)
    for _ in range(200):
        t = "".join(g.choice(["a ", "b ", "c# ", "a b a\n", "é\n", "\n", " "]) for _ in range(g.randint(0, 60)))
        w = t.encode().split()
        tri = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {k + j for k in range(len(w) - 2) if tri[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if x.strip()]
        assert outliers.base_counts(t) == (len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))


def test_outliers(spark):
    g = random.Random(5)
    words = [f"word{k}" for k in range(400)]
    rows = [(k, " ".join(g.choice(words) for _ in range(120))) for k in range(80)] + [(100, " ".join(g.choice(words) + "###" for _ in range(120))), (101, None), (102, "few words")]
    got = {r.doc_id: r for r in outliers.quality_rules(odd(spark, rows)).collect()}
    assert all(got[k].kept for k in range(80)) and not got[100].kept and not got[100].base_failed and got[101].base_failed and not got[102].kept
    assert outliers.quality_rules(odd(spark, [])).count() == 0
    assert abs(outliers.chi_square_quantile(0.5, 4) - 3.3567) < 1e-3


def test_mcd_matches_all_subsets(spark):
    g = np.random.default_rng(12)
    groups = {}
    for name, n in (("a", 8), ("b", 10), ("c", 12)):
        x = g.normal(size=(n, outliers.D)) @ np.diag([0.1, 0.2, 0.3, 0.2])
        x[: n // 4] += 3 + g.normal(size=outliers.D)
        groups[name] = x
    rows = [(name, *map(float, r)) for name, x in groups.items() for r in x]
    got = {r.grp: r for r in outliers.mcd(spark.createDataFrame(rows, "grp string, " + ", ".join(f"x{i} double" for i in range(outliers.D)))).collect()}
    for name, x in groups.items():
        h = math.ceil(outliers.CORE * len(x))
        best = min((np.linalg.slogdet(np.cov(x[list(s)].T, bias=True) + np.diag(np.array(outliers.FLOOR) ** 2))[1], s) for s in itertools.combinations(range(len(x)), h))
        core = x[list(best[1])]
        assert abs(got[name].logdet - best[0]) < 1e-6
        assert np.allclose([got[name][f"m{i}"] for i in range(outliers.D)], core.mean(axis=0))
        assert np.allclose(outliers._matrix(got[name].asDict(), floor=False), np.cov(core.T, bias=True))


def test_outliers_planted(spark):
    g = random.Random(6)

    def prose(n, size):
        return [" ".join("".join(g.choice("abcdefghij") for _ in range(g.randrange(size - 2, size + 3))) for _ in range(12)) for _ in range(n)]

    def planted(share):
        words = " ".join(prose(10, 6)).split()
        return " ".join(w + "#" * k for w, k in zip(words, np.diff(np.floor(np.arange(len(words) + 1) * 6 * share / (1 - share))).astype(int)))

    rows = [(1000 * s + k, "\n".join(prose(10, size)), f"s{s}") for s, size in enumerate((6, 8)) for k in range(100)]
    rows += [(5000 + k, planted(k / 100), "s0") for k in range(2, 11)]  # percent of symbols
    rows += [(6000, "\n".join(f"{x}\nok" for x in prose(10, 6)), "s0")]  # nearly half of the lines repeat, no words do
    rows += [(7000, "\n".join(prose(10, 8)), "s0"), (7001, "\n".join(prose(10, 6)), "s1")]  # the other source's words
    got = {r.doc_id: r for r in outliers.quality_rules(spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, source string, lang string")).collect()}
    assert not any(r.base_failed for r in got.values())
    assert {i for i, r in got.items() if not r.kept} == {i for i, _, _ in rows if i >= 5000}


def test_toxicity_marks(spark, monkeypatch):
    bad = toxicity.INSULTS[0]
    texts = [f"You are {bad}.", f"THEY ARE {bad.upper()}.", f"he is a {bad} " * 25 + f"and {bad}!", f"{bad.upper()} !", "you are kind!"]
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % toxicity.HELD_MOD != toxicity.HELD_REST][: len(texts)]
    got = []
    monkeypatch.setattr(toxicity.ToxicityModel, "fit", lambda t, y: got.extend(t))
    toxicity.learn(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string"), spark.createDataFrame([(i, 1) for i in ids], "doc_id long, toxic int"))
    marks = lambda t: (bool(toxicity.ADDRESS.search(t.lower())), bool(toxicity.SHOUT.search(t)))
    assert [marks(t) for t in got] == [marks(t) for t in texts] == [(True, False), (True, False), (True, True), (False, True), (False, False)]


def test_label_model_by_enumeration():
    g = np.random.default_rng(7)
    y = g.random(4000) < 0.3
    v = np.where(g.random((4000, 5)) < np.where(y, 0.5, 0.05)[:, None], 1, 0)
    v[:, 1] = np.where(g.random(4000) < 0.8, v[:, 0], v[:, 1])  # a voter that copies another
    v[:, 4] = -(~(v[:, :4] == 1).any(axis=1)).astype(int)
    model = toxicity.LabelModel(0.3).fit(v.astype(np.int8))
    assert any({0, 1} <= set(group) for group in model.groups) and sorted(k for group in model.groups for k in group) == list(range(5))

    def joint(votes, label):
        p = model.prior if label else 1 - model.prior
        for group, table in zip(model.groups, model.tables[label]):
            p *= table[sum((votes[k] + 1) * 3**at for at, k in enumerate(group))]
        return p

    every = list(itertools.product((-1, 0, 1), repeat=5))
    assert abs(sum(joint(x, label) for x in every for label in (0, 1)) - 1) < 1e-9
    want = [joint(x, 1) / (joint(x, 0) + joint(x, 1)) for x in every]
    assert np.allclose(model.posterior(np.array(every)), want, atol=1e-9)
    assert np.mean((model.posterior(v) > 0.5) == y) > 0.85


def test_newton_matches_gradient_descent():
    g = np.random.default_rng(2)
    x = g.normal(size=(60, 3))
    y = (x @ [1.0, -2.0, 0.5] + g.normal(size=60) > 0).astype(int)
    d = x[g.choice(np.flatnonzero(y == 1), 400)] - x[g.choice(np.flatnonzero(y == 0), 400)]
    w = np.zeros(3)
    for _ in range(20_000):
        w += 0.5 * (d.T @ (1 / (1 + np.exp(d @ w))) / len(d) - 1e-2 * w)
    assert np.allclose(quality.BradleyTerry.weights_of(d, 1e-2), w, atol=1e-5)


def test_classifiers(spark, sf, labelled):
    for fit, mod, rest, col in ((lambda t, y: quality.BradleyTerry.fit(quality.matrix(t), y), 4, 2, 2), (toxicity.ToxicityModel.fit, 3, 1, 3)):
        held = [zlib.crc32(str(r[0]).encode()) % mod == rest for r in labelled]
        model = fit([r[1] for r, h in zip(labelled, held) if not h], np.array([r[col] for r, h in zip(labelled, held) if not h]))
        test = [r for r, h in zip(labelled, held) if h]
        s = model.score([r[1] for r in test])
        assert np.mean((s >= 0.7) == np.array([r[col] for r in test])) > 0.85
    labels = table(spark, sf, "labels")
    for m in (quality, toxicity):
        model = m.learn(table(spark, sf, "documents"), labels)
        got = m.score(odd(spark), model).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
        flat = m.learn(odd(spark), labels.limit(0))
        assert all(r.score == 0.5 for r in m.score(odd(spark), flat).collect())
    assert quality.keep_good(odd(spark), labels).columns == odd(spark).columns
