"""The corpus pipeline's stages, each on what the one before kept, against plain versions."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillstream.llm import quality, toxicity
from quillstream.llm.common import fold_words, materialize, table

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def _grams(text):
    w = fold_words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def _one_of_each_group(rows):
    """The least (id, text) of each group of linked texts; rows without an id stay."""
    named = sorted({(r.doc_id, r.text or "") for r in rows if r.doc_id is not None})
    sets = [_grams(t) for _, t in named]
    left, kept = set(range(len(named))), []
    while left:
        todo = [min(left)]
        kept.append(named[todo[0]])
        left -= set(todo)
        while todo:
            a = todo.pop()
            near = [b for b in left if sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
            left -= set(near)
            todo += near
    return sorted(kept) + [(None, r.text or "") for r in rows if r.doc_id is None]


def _contaminated(text, items):
    w = fold_words(text)
    hit = set()
    for item in items:
        k = min(13, len(item))
        windows = {tuple(item[s : s + k]) for s in range(len(item) - k + 1)} if k else set()
        for s in range(len(w) - k + 1) if k else ():
            if tuple(w[s : s + k]) in windows:
                hit.update(range(s, s + k))
    return bool(hit) and 20 * len(hit) >= len(w)


def test_stages(spark, sf):
    import sentencepiece

    docs = table(spark, sf, "documents")
    item = table(spark, sf, "benchmark").orderBy("item_id").first().text
    good = docs.orderBy(F.length("text").desc()).limit(4).collect()
    odd = [(None, None), (9001, ""), (9001, ""), (9002, "one two"), (None, good[0].text), (9003, good[1].text), (9003, good[1].text + " end"), (9004, item), (9005, "x" * 70_000)]
    extra = spark.createDataFrame([(i, t, None, None, None) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long")
    now, _ = materialize(docs.select(extra.columns).unionByName(extra), "odd-documents")
    labels = table(spark, sf, "labels")
    items = [fold_words(r.text) for r in table(spark, sf, "benchmark").collect()]
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for (name, stage), n in zip(corpus_pipeline.STAGES, range(5), strict=True):
        before = now.collect()
        out, _ = materialize(stage(spark, now, sf), "stage")
        after = out.collect()
        if n == 4:
            assert sorted((r.doc_id is None, r.doc_id or 0, r.ids) for r in after) == sorted((r.doc_id is None, r.doc_id or 0, lib.encode(r.text or "")) for r in before)
            assert all(r.round_trip and r.n_tokens == len(r.ids) for r in after)
            break
        assert out.columns == docs.columns, name
        if n < 2:
            model = (quality, toxicity)[n].learn(now, labels)
            scores = model.score([r.text for r in before])
            want = [(r.doc_id, r.text or "") for r, s in zip(before, scores) if (s >= 0.7) == (n == 0)]
        elif n == 2:
            want = _one_of_each_group(before)
        else:
            want = [(r.doc_id, r.text or "") for r in before if not _contaminated(r.text, items)]
        assert sorted(((r.doc_id, r.text or "") for r in after), key=key) == sorted(want, key=key), name
        # What a stage kept goes on, with the odd rows that the classifiers may have rejected.
        now, _ = materialize(out.unionByName(extra) if n == 1 else out, "kept")
    empty = now.limit(0)
    assert all(stage(spark, empty, sf).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_keep_uncontaminated_keeps_columns(spark):
    from quillstream.llm import decontaminate

    docs = spark.createDataFrame([(1, "a b c", 77, 5, 6), (2, "x y z", 78, 5, 6), (None, None, 79, 5, 6)], "doc_id long, text string, _key long, low long, high long")
    bench = spark.createDataFrame([(1, "A b C")], "item_id long, text string")
    kept = decontaminate.keep_uncontaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r._key for r in kept.collect()) == [78, 79]
