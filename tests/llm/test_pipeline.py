import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def docs_of(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_each_stage_keeps_columns_and_takes_effect(spark, sf, tmp_path):
    docs = docs_of(spark, sf)
    before = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        last = k == len(corpus_pipeline.STAGES) - 1
        if not last:
            assert out.schema.simpleString() == docs.schema.simpleString(), name
        out.write.parquet(str(tmp_path / str(k)))
        again = spark.read.parquet(str(tmp_path / str(k)))
        if not last:
            ids = {r.doc_id for r in again.select("doc_id").collect()}
            assert ids <= {r.doc_id for r in docs.select("doc_id").collect()}, name
            assert len(ids) > 0.5 * before
        docs = again
    assert docs.columns[:3] == ["pack_id", "slot", "doc_id"]


def test_run_equals_the_stages_by_hand(spark, sf):
    docs = docs_of(spark, sf)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, docs.collect()))


def test_stages_take_odd_rows(spark, sf, odd_docs, no_docs):
    for start in (odd_docs, no_docs):
        docs = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == start.columns, name
        rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
        assert bool(rows) == (start is odd_docs)


def brute_pipeline(docs, labels):
    """All five stages by loops and dictionaries over (doc_id, text, lang), toxicity with the embeddings of a plain training."""
    from lectern.llm import packing, simhash, toxicity
    from lectern.llm.language_id import MARGIN
    from test_language_id import plain_model, plain_scores
    from test_packing import brute as packs
    from test_repeats import brute as repeats
    from test_simhash import components
    from test_toxicity import plain_probability

    model = plain_model(docs)
    kept = []
    for doc, text, lang in docs:
        total, grams = plain_scores(model, text)
        best = max(total, key=total.get)
        if (text or "").strip() and (best == lang or lang not in total or round((total[best] - total[lang]) / grams, 6) <= MARGIN):
            kept.append((doc, text, lang))
    marks = {}
    for doc, y in labels:
        marks[doc] = max(y, marks.get(doc, 0))
    rows = sorted((d, t) for d, t, _ in kept if d in marks)
    tox = toxicity.train([t for _, t in rows], [marks[d] for d, _ in rows])
    kept = [r for r in kept if round(plain_probability(tox, r[1]), 6) < toxicity.THRESHOLD]
    kept.sort()
    prints, has = simhash.fingerprints([t for _, t, _ in kept])
    bits = [sum(int(w) << (64 * k) for k, w in enumerate(f)) for f in prints]
    near = [(i, j) for i in range(len(bits)) for j in range(i + 1, len(bits)) if has[i] and has[j] and (bits[i] ^ bits[j]).bit_count() <= simhash.THRESHOLD]
    kept = [r for i, r in enumerate(kept) if components(len(kept), near)[i] == i]
    _, cut = repeats([(d, t) for d, t, _ in kept], 50)
    lengths = [len([w for k, w in enumerate(t.split()) if k not in cut[d]]) for d, t, _ in kept]
    size = packing.CAPACITY
    made = packs([n % size for n in lengths if n % size], size)
    return sorted(map(tuple, made)) + [(size,)] * sum(n // size for n in lengths), {d: n for (d, _, _), n in zip(kept, lengths) if n}


def test_run_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text, r.lang) for r in docs_of(spark, sf).collect()]
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    packs, lengths = brute_pipeline(docs, labels)
    rows = corpus_pipeline.run(spark, sf).collect()
    words, made = {}, {}
    for r in rows:
        words[r.doc_id] = words.get(r.doc_id, 0) + r.n_words
        made.setdefault(r.pack_id, []).append((r.slot, r.n_words))
    assert words == lengths
    assert sorted(tuple(n for _, n in sorted(p)) for p in made.values()) == sorted(packs)


def test_a_worker_gives_back_what_its_task_took(spark):
    """200 MB of small blocks are freed below one that stays, so the heap can't shrink by itself."""
    from lectern.llm.common import tidied

    def held():
        import re
        from pathlib import Path

        return int(re.search(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) // 1024

    def run(batches):
        import ctypes

        take = ctypes.CDLL(None).malloc
        free = ctypes.CDLL(None).free
        take.restype, free.argtypes = ctypes.c_void_p, [ctypes.c_void_p]
        for batch in batches:
            places = [take(4000) for _ in range(50_000)]
            for p in places:
                ctypes.memset(p, 1, 4000)
            for p in places[:-1]:  # the last one keeps the heap from shrinking by itself
                free(p)
            yield batch

    def measured(batches):
        before = held()
        yield from tidied(run(batches))
        import pandas as pd

        yield pd.DataFrame({"id": [held() - before]})

    kept = [r.id for r in spark.range(1, 2, 1, 1).mapInPandas(measured, "id bigint").collect()]
    assert kept[0] == 1 and kept[1] < 60


def test_repeats_are_cut_in_one_pass_of_python(spark, sf):
    plan = corpus_pipeline.cut_repeats(spark, docs_of(spark, sf), sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
