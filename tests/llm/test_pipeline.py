"""The pipeline's stages act on the whole output of the stage before."""
import corpus_pipeline
from fleetpulse.llm import contamination, minhash_dedup, suffix_dedup, toxicity

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "repeated_strings", "decontamination", "sequences"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").cache()
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], SMALL).cache())
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in seen]
    assert all(df.columns == docs.columns for df in seen[:-1])
    toxic = {r.doc_id for r in toxicity.toxicity(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).where("predicted = 1").collect()}
    assert toxic and ids[1] == ids[0] - toxic
    assert ids[2] == {r.doc_id for r in minhash_dedup.near_duplicates(seen[1], 5, 80).where("kept").collect()}
    assert ids[3] == ids[2]
    left = {r.doc_id: r.n_bytes - r.n_removed for r in suffix_dedup.byte_report(seen[2]).collect()}
    assert sum(left.values()) <= sum(len(r.text.encode()) for r in seen[3].collect())
    leaks = {r.doc_id for r in contamination.contaminated(seen[3], spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    assert ids[4] == ids[3] - leaks == ids[5]
