"""Every stage of the pipeline on nulls, empty and long texts, ties, repeated rows and empty tables."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_llm import DOCS, ODD, SMALL

from tidemark.llm import queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    """Documents of the fixture with odd rows among them, twice, and a column that is none of theirs."""
    own = queries.table(spark, SMALL, "documents").select(COLUMNS)
    odd = spark.createDataFrame([*ODD, *ODD], DOCS)
    return own.unionByName(odd).withColumn("score", F.lit("other")).cache()


def rows(df):
    return Counter(tuple(r) for r in df.select(COLUMNS).collect())


def texts(counter):
    return {(r[0], r[1]) for r in counter}


def test_filters_keep_or_drop_all_rows_of_a_text(spark, docs):
    import corpus_pipeline as C

    given = rows(docs)
    for stage in (C.language, C.good_quality):
        kept = stage(spark, docs, SMALL)
        assert kept.columns == COLUMNS
        got = rows(kept)
        assert all(got[r] == given[r] for r in got)  # repeated rows share one fate
        by_text = {}
        for r in given:
            by_text.setdefault(r[1], set()).add(r in got)
        assert all(len(v) == 1 for v in by_text.values())  # whatever their id, lang or source
        assert len(got) > len(given) / 2
    language = rows(C.language(spark, docs, SMALL))
    assert not [r for r in language if not (r[1] or "").strip()]


def test_near_dedup_keeps_one_row_of_each_group(spark, docs):
    import corpus_pipeline as C

    got, given = rows(C.near_dedup(spark, docs, SMALL)), rows(docs)
    assert set(got.values()) == {1} and set(got) <= set(given)
    assert len([r for r in got if not (r[1] or "").strip()]) == 1  # texts without words are one group
    same = [r for r in got if r[1] == "the same words again and again"]
    assert [r[0] for r in same] == [1]
    assert [r[1] for r in got if r[0] is None] == ["no id at all here"]
    assert any(r[0] == 4 and len(r[1]) == 120_000 for r in got)


def test_mixture_takes_rows_that_are_there(spark, docs):
    import corpus_pipeline as C

    got, given = rows(C.mixture(spark, docs, SMALL)), rows(docs)
    assert set(got) <= set(given) and all(n <= 2 * given[r] for r, n in got.items())
    assert rows(C.mixture(spark, docs, SMALL)) == got
    for r in {x for x in given if given[x] > 1}:  # copies of one row differ by one at most
        assert got[r] in range(2 * given[r] + 1)
    assert {r[3] for r in got} == {r[3] for r in given if (r[1] or "").strip()}


def test_tokens_of_every_row(spark, docs):
    import corpus_pipeline as C

    got = C.tokens(spark, docs, SMALL).collect()
    assert len(got) == docs.count()
    blank = Counter((r[0], r[1]) for r in docs.select("doc_id", "text").collect() if not (r[1] or "").strip())
    assert Counter(r.doc_id for r in got if r.n_tokens == 0) == Counter({i: n for (i, _), n in blank.items()})
    assert all(r.n_tokens == len(r.ids) for r in got)


def test_stages_of_an_empty_table(spark, docs):
    import corpus_pipeline as C

    for name, stage in C.STAGES:
        none = stage(spark, docs.limit(0).select(COLUMNS), SMALL)
        assert none.count() == 0, name
        if stage is not C.STAGES[-1][1]:
            assert none.columns == COLUMNS
