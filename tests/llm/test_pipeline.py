from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from tests.llm.helpers import documents, frame, lower, words

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tessera.llm import quality  # noqa: E402


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "source_mix", "packing"]


def test_run_on_a_small_folder(spark, tmp_path):
    rows = documents(n=90)
    names = ["_gone", "_shard", "_may", "n", "row", "h", "part", "id"]  # of columns that operators make for themselves
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(7).alias(n) for n in names])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
        ids = [r.doc_id for r in kept.select("doc_id").collect()]
        assert set(ids) <= {r.doc_id for r in before.select("doc_id").collect()}
        assert name == "source_mix" or len(ids) == len(set(ids)), name
    copies = Counter(r.doc_id for r in kept.collect())
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(p.doc_id for p in pieces if p.start == 0) == copies
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    kept_texts = [texts[i] for i in copies if i is not None]
    assert all(len(words(t)) >= 10 for t in kept_texts) and len({lower(t) for t in kept_texts}) == len(kept_texts)


def test_stages_match_brute_force(spark, tmp_path):
    """What the first three stages keep, recomputed in plain Python from the rules' own counts."""
    rows = [r for r in documents(n=90) if r[0] is not None]
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    judged = {r.doc_id: r.kept for r in quality.quality(docs).collect()}
    good = [r for r in {r[0]: r for r in rows}.values() if judged[r[0]]]
    largest = {}
    for r in good:
        largest[lower(r[1])] = max(r[0], largest.get(lower(r[1]), -1))
    left = {r[0]: r[1] for r in good if largest[lower(r[1])] == r[0]}
    sets = {i: {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} for i, t in left.items() for ws in [words(lower(t))]}
    group = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, g in group.items() if g == i)


def test_stages_take_empty_tables(spark, tmp_path):
    docs = frame(spark, []).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0


def test_packed_sequences_hold_their_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    from tessera.llm.queries import op4_packing, vocabulary

    rows = [r for r in documents(n=90) if r[0] is not None]
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    tokenizer, texts = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), {r[0]: r[1] for r in rows}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    for p in pieces:
        ids = [*tokenizer.encode(texts[p.doc_id], add_special_tokens=False).ids, 0]
        assert p.ids == np.array(ids[p.start : p.start + p.length], "<u4").tobytes()
    plan = op4_packing(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("crc32") < plan.index("FlatMapGroupsInPandas")  # the digest is of what was packed
