import pytest

import corpus_pipeline
from agrovane.llm import decontaminate
from tests.llm.conftest import prose
from tests.llm.test_quality_rules import base
from tests.llm.test_superminhash import expected as near_groups

ITEM = "what is the capital of the country that borders both seas and has two rivers"
KEY = "password=Qw3rTy99Zz81xk"


@pytest.fixture
def folder(tmp_path, spark, frame):
    rows = [(k, " ".join(prose(k, 80 + k)), f"s{k % 3}") for k in range(60)]
    rows += [(100 + k, rows[k][1] + " tail", "s1") for k in range(10)]
    rows += [(200 + k, " ".join([*prose(500 + k, 40), ITEM, *prose(600 + k, 40)]), "s2") for k in range(5)]
    rows += [(300, " ".join(prose(700, 90)) + " " + KEY, "s0"), (301, None, "s0"), (302, "short", None), (303, "a b c " * 60, "s0")]
    rows += [(304, " ".join(prose(701, 90)), None), (304, " ".join(prose(701, 90)), None), (None, " ".join(prose(702, 90)), "s1")]
    frame(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return rows, str(tmp_path)


def test_stages_against_brute_force(spark, folder):
    rows, path = folder
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), rows
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "minhash_near_dedup", "benchmark_decontamination", "secret_scan", "mixing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        out.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        if name == "quality_rules":
            kept = [r for r in kept if not base(r[1])[-1]]
        elif name == "minhash_near_dedup":
            least = {i for _, _, i, _ in near_groups(kept)}
            first = {}
            for r in kept:
                if r[0] in least:
                    first.setdefault(r[0], r)
            kept = list(first.values())
        elif name == "benchmark_decontamination":
            kept = [r for r in kept if decontaminate.normalised(ITEM) not in decontaminate.normalised(r[1])]
        else:
            kept = [(i, t.replace(KEY, "[assign]"), s) for i, t, s in kept]
        assert sorted(((r["doc_id"], r["text"], r["source"]) for r in docs.collect()), key=repr) == sorted(kept, key=repr), name
    assert {r[0] for r in kept} >= set(range(60)) | {300, 304, None}


def test_run(spark, folder):
    _, path = folder
    first, again = (sorted(map(repr, corpus_pipeline.run(spark, path).collect())) for _ in range(2))
    assert first == again and len(first) > 20


def test_empty_table(spark, folder, frame, tmp_path):
    empty = tmp_path / "none"
    frame([]).write.parquet(str(empty / "documents.parquet"))
    spark.read.parquet(f"{folder[1]}/benchmark.parquet").write.parquet(str(empty / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).collect() == []
