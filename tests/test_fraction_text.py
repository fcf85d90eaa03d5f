"""Text of numbers as SQL writes it."""

from pyspark.sql import functions as F

from skein.functions.text import fraction_text


def test_every_fraction_of_a_digest_is_written_as_sql_does(spark):
    # 3 / 65535 was 4.5777065690089265E-5, 54 / 65535 was 8.239871824216068E-4
    rows = spark.range(65536).select("id", fraction_text(F.col("id").cast("double") / 65535.0).alias("s")).collect()
    assert [r for r in rows if r["s"] != repr(r["id"] / 65535.0)] == []
