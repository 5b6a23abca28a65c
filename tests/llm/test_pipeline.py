"""The pipeline's stages against brute-force versions of each, on the smallest table."""

import pytest

import corpus_pipeline
from lintlake.llm.common import stored
from lintlake.llm.tokens import count_of

from .conftest import ODD, prose
from .test_operators import brute_join, brute_lines, sets

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF_DIR), "stage"))
    return out


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    docs, clean, lines, single, safe, packed = stages
    assert all(s.columns == docs.columns for s in stages[1:-1])
    assert 0 < clean.count() <= docs.count() and set(texts(clean)) <= set(texts(docs))
    assert sorted(texts(lines), key=str) == sorted(((i, t) for i, _, _, t in brute_lines(texts(clean), 5)), key=str)
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    assert {i for i, _ in texts(single)} == {c for _, c, _ in brute_join(texts(lines))}
    items = [sets(r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    assert {i for i, _ in texts(safe)} == {i for i, t in texts(single) if not any(q and len(q & sets(t)) >= 0.8 * len(q) for q in items)}
    rows = packed.collect()
    assert sum(r.length for r in rows) == sum(count_of(t) + 1 for _, t in texts(safe))


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF_DIR).count() == stages[-1].count()


ITEM = prose(900, 12)


@pytest.fixture
def small(spark, tmp_path):
    """A folder with labels and a benchmark, nulls among them."""
    spark.createDataFrame([(1, 1, 0), (5, None, None), (None, 0, 1), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, ITEM), (None, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages_of_odd_rows(spark, docs_of, small):
    leaks = [(None, "before " + ITEM), (5, ITEM + " after"), (300, f"x {ITEM} y")]
    docs = docs_of(ODD + leaks)
    by_name = dict(corpus_pipeline.STAGES)
    rows = {n: stage(spark, docs, small) for n, stage in corpus_pipeline.STAGES}
    assert all(rows[n].columns == docs.columns for n in list(by_name)[:-1])
    key = lambda r: (str(r[0]), str(r[1]))
    every = sorted(((i, t) for i, t in ODD + leaks), key=key)
    # Nothing is toxic among the labels that count, no line is common, and only the leaks hold the item.
    assert sorted(texts(rows["toxicity"]), key=key) == every
    assert sorted((i for i, _ in texts(rows["line dedup"])), key=str) == sorted((i for i, _ in every), key=str)
    assert sorted(texts(rows["benchmark decontamination"]), key=key) == sorted(ODD, key=key)
    single = texts(rows["n-gram Jaccard join"])
    assert [i for i, _ in single].count(None) == sum(i is None for i, _ in ODD + leaks)
    assert {3, 9, 11, 12}.isdisjoint({i for i, _ in single}) and {1, 2, 5, 7, -4, 2**62} <= {i for i, _ in single}
    assert sum(r.length for r in rows["packing"].collect()) == sum(count_of(t) + 1 for _, t in every)


def test_stages_of_empty_tables(spark, docs_of, small):
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs_of([]), small)
        assert rows.count() == 0 and (name == "packing" or rows.columns == docs_of([]).columns), name
