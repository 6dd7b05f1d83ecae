"""The pipeline's stages against brute force, each on its own input."""

from collections import Counter, defaultdict

import pytest

import __spark_entry__
import corpus_pipeline
from chronoweave.llm import common, mixing

from .test_operators import WORD, brute_classes, brute_targets, check_packing

SF = "/root/testdata/sf0.001"


def test_stages_and_registration():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard_join", "mix_sources", "pack_best_fit"]
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_stage_by_stage(spark):
    extra = [(10_001, None, "en", "src1", None), (10_002, "12345 !!", "en", "src1", 8), (10_003, "", None, None, 0), (10_004, "Съешь же ещё этих мягких французских булок " * 9, None, "src1", 300)]
    docs = common.read_table(spark, SF, "documents")
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns

    kept = common.stage(stages["language_id"](spark, docs, SF), "t")
    before, after = docs.collect(), kept.collect()
    assert kept.columns == columns and {r.doc_id for r in before} - {r.doc_id for r in after} == {10_001, 10_002, 10_003, 10_004}

    unique = common.stage(stages["exact_dedup"](spark, kept, SF), "t")
    first = {}
    for r in after:
        first[r.text] = min(first.get(r.text, r.doc_id), r.doc_id)
    assert unique.columns == columns and sorted(r.doc_id for r in unique.collect()) == sorted(first.values())

    apart = common.stage(stages["ngram_jaccard_join"](spark, unique, SF), "t")
    rows = [(r.doc_id, r.text) for r in unique.collect()]
    assert apart.columns == columns and sorted(r.doc_id for r in apart.collect()) == sorted(set(brute_classes(rows)))

    mixed = common.stage(stages["mix_sources"](spark, apart, SF), "t")
    sizes, largest, of = defaultdict(int), defaultdict(int), {}
    for r in apart.collect():
        n = len(WORD.findall(r.text or ""))
        of[r.doc_id] = (r.source, n)
        sizes[r.source] += n
        largest[r.source] = max(largest[r.source], n)
    taken, copies = defaultdict(int), Counter(r.doc_id for r in mixed.collect())
    for d, n in copies.items():
        taken[of[d][0]] += n * of[d][1]
    assert mixed.columns == columns and max(copies.values()) <= 2
    assert all(taken[s] == pytest.approx(t, abs=largest[s]) for s, t in brute_targets(sizes).items())
    assert copies == Counter({r.doc_id: r.copies for r in mixing.copies(apart).collect() if r.copies})

    packed = stages["pack_best_fit"](spark, mixed, SF).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == copies
    check_packing(packed, [r.length for r in packed], 2048)


def test_stages_on_odd_tables(spark, empty):
    """Empty tables, repeated rows, null ids and columns that clash with the operators' names go through every stage."""
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint, lang_pred string, _lang string, size string, copies string, key string"
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (2, text + " eleven", "en", "a"), (None, "a quite different text than all others here", "en", None), (None, None, None, None), (4, "der Hund und die Katze", "de", "b")]
    odd = spark.createDataFrame([(*r, len(r[1] or ""), "x", "y", "s", "c", "k") for r in rows], columns)
    for docs, left in ((odd, 3), (odd.limit(0), 0)):
        names = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.stage(stage(spark, docs, SF), "odd")
            assert docs.columns == names, name
            if name == "ngram_jaccard_join":
                assert docs.count() == left
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0) == (left > 0)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
