"""The pipeline on a small table, stage by stage against plain Python."""

import shutil

import corpus_pipeline
import __spark_entry__
from entigraph.llm import language

from .test_operators import brute_components, brute_contamination, prose

BENCH = prose(50, 40)
KEY = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae"


def test_pipeline(spark, tmp_path):
    train = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    english = [r.text for r in train.where("lang = 'en'").orderBy("doc_id").limit(6).collect()]
    own = [*english, english[3] + " ", None, "12 34 !!", "", "We keep " + BENCH, english[4] + f' token = "{KEY}" and so on', english[0]]
    rows = [(10_000 + i, t, None, "src0", len(t or "")) for i, t in enumerate(own)]
    d = train.unionByName(spark.createDataFrame(rows, train.schema))
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, BENCH)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept, steps = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, str(tmp_path))
        steps.append(kept)
        if name != "best_fit_packing":
            assert kept.columns == d.columns
            kept.write.parquet(str(tmp_path / name))
            kept = spark.read.parquet(str(tmp_path / name))
    tables = [d.collect(), *[spark.read.parquet(str(tmp_path / n)).collect() for n, _ in corpus_pipeline.STAGES[:-1]]]

    model = language.train(d)
    known, _ = zip(*zip(*model.decide([r.text for r in tables[0]])))
    assert {r.doc_id for r in tables[1]} == {r.doc_id for r, (y, _) in zip(tables[0], zip(*model.decide([r.text for r in tables[0]]))) if y != "und"} and known
    groups = brute_components([(r.doc_id, r.text) for r in tables[1]], 5, 80)
    assert sorted(r.doc_id for r in tables[2]) == sorted(i for i, (_, _, keep) in groups.items() if keep)
    bad = brute_contamination([r.text for r in tables[2]], [(1, BENCH)])
    assert {r.doc_id for r in tables[3]} == {r.doc_id for r, x in zip(tables[2], bad) if not x[3]} and any(x[3] for x in bad)
    assert [r.doc_id for r in sorted(tables[4], key=lambda r: r.doc_id)] == [r.doc_id for r in sorted(tables[3], key=lambda r: r.doc_id)]
    assert not any(KEY in r.text for r in tables[4])
    packed = steps[-1].collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in tables[4]}
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in again) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed)
    shutil.rmtree(tmp_path, ignore_errors=True)


def stage_by_stage(spark, folder, d):
    """The tables before and after each stage, written and read again as the pipeline does."""
    d.write.parquet(f"{folder}/documents.parquet")
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    tables = [kept.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept, folder).write.parquet(f"{folder}/{name}")
        kept = spark.read.parquet(f"{folder}/{name}")
        assert name == "best_fit_packing" or kept.columns == d.columns
        tables.append(kept.collect())
    return tables


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null, shared and repeated ids, nulls in any column, and columns with clashing names."""
    folder = str(tmp_path)
    a, b, c = (prose(60 + k, 60) for k in range(3))
    rows = [(None, a, "en", "s", 1), (None, a + " tail", None, None, None), (5, b, "en", "s", 1), (5, c, "en", "s", 1), (5, c, "en", "s", 1), (6, b + " more", "xx", "s", 1),
            (None, "We keep " + BENCH, "en", None, 1), (8, None, None, None, None), (None, None, None, None, None), (9, f'{prose(70, 40)} token = "{KEY}"', "en", "s", 1), (5, "", "en", "s", 0)]
    clash = ["findings", "redacted", "hash", "node", "cls", "row", "_hash_of_the_text", "score"]
    d = spark.createDataFrame([(*r, *[k] * len(clash)) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in clash))
    spark.createDataFrame([(1, BENCH), (None, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    tables = stage_by_stage(spark, folder, d)
    ids = lambda t: sorted((str(r.doc_id), (r.text or "")[:8]) for r in t)
    assert len(tables[1]) == 8 and all(r.text for r in tables[1])
    assert ids(tables[2]) == sorted([("None", a[:8]), ("5", b[:8]), ("5", c[:8]), ("None", "We keep "), ("9", prose(70, 40)[:8])])
    assert ids(tables[3]) == ids([r for r in tables[2] if not r.text.startswith("We keep ")])
    assert ids(tables[4]) == ids(tables[3]) and [r.text.endswith('token = "[SECRET]"') for r in tables[4] if r.doc_id == 9] == [True]
    assert [r.n_chars == len(r.text) for r in tables[4] if r.doc_id == 9] == [True]
    assert len({(r.doc_id, r.ids_crc32) for r in tables[5]}) == 4


def test_pipeline_of_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    d = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert stage_by_stage(spark, folder, d) == [[]] * 6


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
