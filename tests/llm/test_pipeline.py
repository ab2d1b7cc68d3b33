import corpus_pipeline
import zlib

import numpy as np
import public_tokenizers
from clicklake.llm import decontamination, packing, toxicity
from clicklake.llm.common import Scratch
from tokenizers import Tokenizer

from .test_near_duplicates import Union, _groups, brute_lines
from .test_other_operators import brute_lcs

DATA = "/root/testdata/sf0.001"


def test_stages(spark, documents):
    scratch, docs, seen = Scratch(spark, "t"), documents, []
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.cut(stage(spark, docs, DATA), name.replace(" ", "-"))
        seen.append((name, docs, out))
        docs = out
    for name, before, after in seen[:-1]:
        assert after.columns == documents.columns, name
        assert after.join(before, "doc_id", "left_anti").isEmpty()
        assert after.count() >= 0.8 * before.count(), name
    (_, clean, _), (_, toxic_free, lines) = seen[0], seen[1]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    assert toxic_free.join(labels.filter("toxic = 0"), "doc_id").count() == clean.join(labels.filter("toxic = 0"), "doc_id").count()
    assert lines.count() == toxic_free.count()
    packed = seen[-1][2]
    assert packed.select("doc_id").distinct().count() == seen[-1][1].count()


def test_stages_take_odd_rows(spark, tmp_path):
    rows = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (2, None, None, None, None), (None, "", None, "s", 0), (3, "word " * 20_000, "en", "s", 100_000)]
    for docs in (rows, []):
        df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
        scratch = Scratch(spark, "t")
        for name, stage in corpus_pipeline.STAGES:
            df = scratch.cut(stage(spark, df, DATA), name.replace(" ", "-"))
        assert (df.count() > 0) == bool(docs)


def five_word_sets(texts):
    words = [(t or "").encode().lower().split() for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]


def test_stages_equal_brute_force(spark, documents):
    """Each stage on what the one before kept, against plain Python over all rows, all pairs, all items."""
    stages, scratch = dict(corpus_pipeline.STAGES), Scratch(spark, "t")
    run = lambda name, docs: scratch.cut(stages[name](spark, docs, DATA), name.replace(" ", "-"))
    rows = lambda df: sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())

    model = toxicity.train(documents, spark.read.parquet(f"{DATA}/labels.parquet"))
    clean = run("toxicity", documents)
    assert rows(clean) == [(d, t) for d, t in rows(documents) if model.score(model.sentences(t)) < 0.5]

    lines = run("line dedup", clean)
    assert rows(lines) == list(zip([d for d, _ in rows(clean)], brute_lines(rows(clean))))

    single, u = run("simhash near-dedup", lines), Union()
    ids, sets = [d for d, _ in rows(lines)], five_word_sets([t for _, t in rows(lines)])
    for i, a in enumerate(sets):
        u.find(ids[i])
        for j in range(i):
            if min(len(a), len(sets[j])) >= 0.8 * max(len(a), len(sets[j])) and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                u.join(ids[i], ids[j])
    assert {d for d, _ in rows(single)} == {min(g) for g in _groups(u, ids)}

    unleaked = run("benchmark decontamination", single)
    items = [decontamination.words_of(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    left = {d for d, _ in rows(unleaked)}
    for d, t in rows(single):
        words = decontamination.words_of(t)
        text = f" {' '.join(words)} "
        if d in left:
            assert not any(f" {' '.join(w)} " in text for w in items)
        else:
            assert any(brute_lcs(w, words) >= 0.6 * len(w) for w in items)

    packed = run("best-fit packing", unleaked).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    whole = {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for d, t in rows(unleaked)}
    for r in packed:
        assert r["ids_crc32"] == zlib.crc32(whole[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
    assert sum(r["length"] for r in packed) == sum(map(len, whole.values()))
    assert len({r["sequence_id"] for r in packed}) <= packing.lower_bound([r["length"] for r in packed], 2048) + 1


def test_stages_keep_columns_with_clashing_names(spark):
    extra = "row_key string, k int, names string, removed int, numbers string, is_toxic int, is_leak int"
    rows = [(i, f"a text of its own {i} " * 9, "en", "s", 1, "x", i, "y", 2, "z", 3, 4) for i in range(6)]
    df = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, DATA)
        assert out.columns == df.columns and {r["row_key"] for r in out.collect()} == {"x"}
