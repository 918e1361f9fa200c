"""Every stage of the pipeline against the brute-force version of its decision."""
import random

import corpus_pipeline
import pytest
from test_operators import brute_groups, brute_hits, check_packing, toxic_rows

from parleo.llm import secret_scan


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    rng = random.Random(11)
    rows = toxic_rows(160)
    labels = [(i, y) for i, _, y in rows]
    docs = [(i, t, "en", f"src{i % 3}", len(t)) for i, t, _ in rows]
    clean = [t for _, t, y in rows if not y]
    item = " ".join("".join(rng.choice("abcde") for _ in range(5)) for _ in range(24))
    extra = [clean[0], clean[0], clean[1] + " one more", f"{clean[2]} {item}", f'{" ".join(reversed(clean[3].split()))} password = "s3cretS3cret99"', None, "", clean[4] + " " + " ".join(clean[5:30])]
    docs += [(1000 + k, t, None, None, len(t or "")) for k, t in enumerate(extra)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars int").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").selectExpr("doc_id", "1 AS quality", "toxic").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), {i: y for i, y in labels}, item


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secret_scan", "packing"]


def test_stages_against_brute_force(spark, folder, tmp_path):
    path, toxic, item = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()} if name != "packing" else before
        out = stage(spark, docs, path)
        if name == "packing":
            rows = out.collect()
            break
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "toxicity":
            gone = before.keys() - kept.keys()
            assert sum(toxic.get(i, 0) for i in gone) >= 0.9 * sum(toxic.values()) and sum(1 for i in gone if not toxic.get(i, 0)) <= 2
        elif name == "near_dedup":
            assert kept.keys() == {i for i, (_, _, k) in brute_groups(before.items(), 5).items() if k}
        elif name == "decontamination":
            hits = brute_hits(before.items(), [(7, item)])
            assert kept.keys() == {i for i, h in hits.items() if h[0][1] == 0} and 1003 not in kept
        else:
            assert kept.keys() == before.keys() and "s3cretS3cret99" not in kept[1004]
            f = secret_scan.Formats({}, [])
            assert all(kept[i] == secret_scan.mask(t or "", f) for i, t in before.items() if t is not None)
            assert all(r["n_chars"] == len(r["text"]) for r in docs.where("text is not null").collect())
    check_packing(rows, len(kept))
    assert {r["doc_id"] for r in rows} == kept.keys()


def test_run_equals_the_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder[0]).collect()
    check_packing(rows, 0)
    assert len({r["doc_id"] for r in rows}) > 80
