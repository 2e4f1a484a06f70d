"""Every stage of the pipeline on nulls, empty and long texts, repeated rows, an empty table, and columns with names that steps use."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def awkward(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60 AND text IS NOT NULL")
    some = docs.limit(3).persist()
    null = lambda c: F.lit(None).cast(docs.schema[c].dataType).alias(c)
    rows = [docs, some, some]  # repeated rows
    rows += [docs.limit(4).select(*[null(c) if c == gone else c for c in docs.columns]) for gone in docs.columns]
    rows.append(docs.limit(1).select(*[null(c) for c in docs.columns]))
    rows += [docs.limit(2).withColumn("text", F.lit(t)) for t in ("", " \n\t ", "12 34 !!", "ein sehr langer text " * 20_000)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    clashing = {c: F.lit(c) for c in ("node", "component_id", "kept", "row", "key", "size", "shard", "row_key", "n_words", "band", "rejected", "lang_pred")}
    return out.withColumns(clashing).persist()


def counted(df, columns):
    return {tuple(map(str, r[:-1])): r[-1] for r in df.groupBy(*columns).agg(F.count(F.lit(1))).collect()}


@pytest.mark.parametrize("name", [n for n in STAGES if n != "sharding"])
def test_stage(spark, awkward, name):
    out = STAGES[name](spark, awkward, SF)
    assert out.columns == awkward.columns
    got, had = counted(out, awkward.columns), counted(awkward, awkward.columns)
    assert set(got) <= set(had)
    texts = {r.text for r in out.select("text").distinct().collect()}
    if name == "language":
        assert got == {k: had[k] for k in got} and not texts & {None, "", " \n\t ", "12 34 !!"} and len(got) > 40
    elif name == "near_duplicates":
        assert all(got[k] == had[k] for k in got) and any(r is None for r in texts) and len(got) > 30  # of equal ids all rows stay or go
    elif name == "decontamination":
        assert got == {k: had[k] for k in got} and {None, "", " \n\t "} <= texts
    else:
        assert all(0 < got[k] <= 3 * had[k] + 1 for k in got) and not texts & {None, "", " \n\t "}
    empty = STAGES[name](spark, awkward.limit(0), SF)
    assert empty.columns == awkward.columns and empty.count() == 0


def test_sharding_stage(spark, awkward):
    out = STAGES["sharding"](spark, awkward, SF)
    assert out.count() == awkward.count()
    assert STAGES["sharding"](spark, awkward.limit(0), SF).count() == 0
