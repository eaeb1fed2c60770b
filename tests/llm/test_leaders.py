from pyspark.sql import functions as F

from locusmill.llm import neardup


def test_a_leader_without_links_hides_no_pair(spark):
    """One bucket holds all three; its leader links with neither of the pair, and no other link is found."""
    ids = spark.range(100).select("id", F.xxhash64("id", F.lit(0)).alias("h")).orderBy("h").limit(3).collect()
    lead, x, y = (r["id"] for r in ids)
    words = [f"w{i}" for i in range(200)]
    docs = spark.createDataFrame([(lead, " ".join(f"v{i}" for i in range(200))), (x, " ".join(words)), (y, " ".join(words[:-2]))], "doc_id long, text string")
    for p in (neardup.SketchParams(), neardup.SketchParams(lead_rounds=1), neardup.SketchParams(lead_rounds=1, small_bucket=2)):
        sketches = neardup.sketch_documents(docs, p).withColumn("keys", F.array(F.lit(1).cast("long")))
        _, labels = neardup.near_duplicate_links(docs, sketches, p)
        assert {r["node"]: r["component"] for r in labels.collect()} == {x: min(x, y), y: min(x, y)}
