"""The corpus pipeline, stage by stage, and the registered queries against their SQL."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from docloom.llm import mixing, queries
from docloom.llm.common import stored

from .test_operators import near_by_hand, targets_by_hand

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{D}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        result = stored(stage(spark, docs, D), name)
        out.append((name, docs.toPandas(), result.toPandas()))
        docs = result
    return {name: (a, b) for name, a, b in out}


def test_columns(spark, stages):
    names = spark.read.parquet(f"{D}/documents.parquet").columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert all(list(b.columns) == names for n, (_, b) in stages.items() if n != "packing")


def test_quality(spark, stages):
    before, after = stages["quality"]
    labels = spark.read.parquet(f"{D}/labels.parquet").toPandas().set_index("doc_id").quality
    kept = set(after.doc_id)
    wrong = [i for i in before.doc_id if i in labels.index and (labels[i] == 1) != (i in kept)]
    assert len(wrong) <= 0.05 * len(labels)
    assert after.merge(before).shape == after.shape


def test_exact(stages):
    before, after = stages["exact_dedup"]
    assert sorted(after.doc_id) == sorted(before.groupby("text").doc_id.max())


def test_near(stages):
    before, after = stages["near_dedup"]
    want = near_by_hand(list(zip(before.doc_id, before.text, strict=True)), 5, 80)
    assert sorted(after.doc_id) == sorted({c for _, c in want.values()})


def test_mixing(stages):
    before, after = stages["mixing"]
    size = {r.doc_id: len(r.text.encode().split()) for r in before.itertuples()}
    source = dict(zip(before.doc_id, before.source, strict=True))
    per = Counter()
    for i, s in source.items():
        per[s] += size[i]
    want, times, got, longest = targets_by_hand(dict(per)), Counter(after.doc_id), Counter(), defaultdict(int)
    for i, n in times.items():
        got[source[i]] += n * size[i]
        assert n <= 3
    for i, s in source.items():
        longest[s] = max(longest[s], size[i])
    assert all(abs(got[s] - want[s]) <= longest[s] for s in per)


def test_mixing_is_in_the_order_of_training(spark, stages):
    docs = spark.createDataFrame(stages["mixing"][0]).repartition(5)
    got = [r.doc_id for r in corpus_pipeline.mix(spark, docs, D).collect()]
    assert got == [r.doc_id for r in mixing.schedule(docs).collect()]


def test_packing(stages):
    before, after = stages["packing"]
    assert Counter(after[after.piece == 0].doc_id) == Counter(before.doc_id)
    assert after.groupby("sequence_id").length.sum().max() <= 1024


def test_run_gives_the_last_stage(spark, stages):
    _, after = stages["packing"]
    again = corpus_pipeline.run(spark, D).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, again[key].values)) == sorted(map(tuple, after[key].values))


@pytest.mark.parametrize("name", queries.SQL)
def test_query_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    a, b = queries.QUERIES[name](spark, D).toPandas(), con.execute(queries.SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)

    def rows(df):
        df = df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None)
        return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.itertuples(index=False)), key=repr)

    assert rows(a) == rows(b)


def awkward(spark, empty=False):
    """Documents with nulls everywhere, repeated rows, empty and long texts, and columns that operators use themselves."""
    good = [(i, " ".join(f"w{(i * 37 + j * 11) % 97}" for j in range(30 + i)), f"s{i % 3}", "en", 1) for i in range(20)]
    rows = [*good, good[3], good[3], (None, good[4][1], "s1", None, None), (None, None, None, None, None), (50, None, "s1", "en", 0), (51, "", None, "en", 0), (52, "long " * 20_000, "s2", "en", 1), (53, good[5][1], None, None, 1)]
    docs = spark.createDataFrame([] if empty else rows, "doc_id long, text string, source string, lang string, n_chars long")
    for c in ("digest", "row", "score", "size", "copies", "id", "comp", "words", "bucket", "sketch", "n", "leaf", "keep_id", "rank", "target", "a", "b"):
        docs = docs.withColumn(c, docs.lang)
    return docs


@pytest.mark.parametrize("empty", [False, True])
def test_awkward_rows_pass_every_stage(spark, empty):
    docs = awkward(spark, empty)
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, D), name)
        rows = out.collect()
        if name != "packing":
            assert out.columns == docs.columns
        if empty:
            assert rows == []
        if name == "exact_dedup" and not empty:
            texts = [r.text or "" for r in rows]
            assert Counter(r.doc_id for r in rows)[3] in (0, 3)  # repeated rows are one document
            assert len({t for t in texts}) == len({r.text or "" for r in docs.collect()})
        if name == "mixing" and not empty:
            assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()} and all((r.text or "").split() for r in rows)
        docs = out
    # Each stage also takes the awkward rows themselves, not only what is left of them.
    for name, stage in corpus_pipeline.STAGES:
        assert (stage(spark, awkward(spark, empty), D).count() == 0) == empty
