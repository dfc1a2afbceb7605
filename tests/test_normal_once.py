"""The normal form of a text is worked out once for all fields, and the two classes of plain characters agree."""

from pyspark.sql import functions as F

from caselake import plans
from caselake.operators import hygiene, masking


def test_fields_share_one_normal_form(spark, tmp_path):
    texts = ["NPI: 12345", "M12345678 and E1234", "PA-2024-00001 CLM-12", "PA-- a@b", "a@b.org", "M١٢٣٤", "CG 1234 5678 9012", "NPI", "", None, "é provider id 1234567890"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    got = plans.registered()["validated_ids"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1
    rows = {r.doc_id: r.flags for r in got.collect()}
    assert rows == {r.doc_id: r.flags for r in docs.select("doc_id", F.to_json(masking.validate_ids(F.col("text"))).alias("flags")).collect()}
    by = [rows[k] for k in range(len(texts))]
    assert by[0] == '{"npi":"invalid: 5 digits"}' and by[1] == '{"member_id":"valid","equipment_code":"valid"}' and by[2] == '{"auth_id":"valid","claim_id":"invalid: expected CLM- and 8 digits"}'
    assert by[3] == '{"auth_id":"invalid: expected PA-YYYY-NNNNN","user_email":"invalid: malformed email"}' and by[5] == '{"member_id":"invalid: 4 digits after M (expected 8)"}' and by[8] == by[9] == "{}"


def test_what_is_not_plain(spark):
    chars = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x10000), *range(0x1F600, 0x1F610)]]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    assert df.filter(F.col("c").rlike(hygiene.UNPLAIN) != F.col("c").rlike(f"[^{hygiene.PLAIN}]")).count() == 0
