"""The language stage against texts of a language and of none that was learned."""

import zlib

from pyspark.sql import functions as F

from tapeloom.llm.string_kernel import keep_identified

FOREIGN = [
    "Η γρήγορη αλεπού πηδά πάνω από τον τεμπέλη σκύλο και φεύγει μακριά. " * 5,
    "สุนัขจิ้งจอกสีน้ำตาลกระโดดข้ามสุนัขขี้เกียจ " * 5,
    "быстрая лиса прыгает через ленивую собаку " * 5,
    "敏捷的棕色狐狸跳过了懒狗。" * 20,
]


def test_unlearned_scripts_go_and_held_out_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    foreign = spark.createDataFrame([(10**9 + i, t, None) for i, t in enumerate(FOREIGN)], docs.schema)
    kept = {r["doc_id"] for r in keep_identified(docs.unionByName(foreign)).select("doc_id").collect()}
    assert not [i for i in kept if i >= 10**9]
    held_out = [r["doc_id"] for r in docs.filter(F.col("lang").isNotNull() & F.col("text").rlike("[a-zA-Z]")).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(held_out) > 500
    assert sum(i in kept for i in held_out) >= 0.99 * len(held_out)
