"""Image header queries."""

from pyspark.sql import functions as F

from curaspark.functions import images as im
from curaspark.plans.catalog import query
from curaspark.plans.standins import table

# the size an image claims, from the length of a text and an id; some sides are zero, huge or very stretched
SIZES = """SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 0 WHEN doc_id % 7 = 0 THEN n_chars * 9 ELSE n_chars END AS w,
  CASE WHEN doc_id % 31 = 0 THEN 0 WHEN doc_id % 11 = 0 THEN 3 ELSE doc_id % 3000 + 1 END AS h FROM {documents}"""


@query(
    "image_dims",
    f"""WITH s AS ({SIZES.format(documents='documents')})
    SELECT doc_id, w AS width, h AS height, (w > 0 AND h > 0 AND GREATEST(w, h) / GREATEST(LEAST(w, h), 1) <= 100 AND w <= 16384 AND h <= 16384) AS ok FROM s""",
)
def image_dims(spark, sf):
    """Sizes are written into real PNG headers, encoded with and without a prefix, and read back."""
    s = spark.sql(SIZES, documents=table(spark, sf, "documents"))

    def side(c):
        return F.lpad(F.hex(F.col(c)), 8, "0")

    header = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), side("w"), side("h"), F.lit("0806000000")))
    text = F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("data:image/png;base64,")).otherwise(F.lit("")), F.base64(header))
    sized = s.select("doc_id", im.png_size(text).alias("size"))
    w, h = F.col("size.width"), F.col("size.height")
    return sized.select("doc_id", w.alias("width"), h.alias("height"), im.is_renderable_size(w, h).alias("ok"))


def _cap(w: str, h: str) -> tuple[str, str]:
    over = f"GREATEST({w}, {h}) / LEAST({w}, {h}) > 199"
    return (
        f"CASE WHEN {over} AND {w} >= {h} THEN GREATEST({h} * 199, 1) ELSE {w} END",
        f"CASE WHEN {over} AND {w} < {h} THEN GREATEST({w} * 199, 1) ELSE {h} END",
    )


@query(
    "image_target_size",
    f"""WITH s AS ({SIZES.format(documents='documents')}), v AS (SELECT * FROM s WHERE w > 0 AND h > 0),
    a AS (SELECT doc_id, {_cap('w', 'h')[0]} AS w, {_cap('w', 'h')[1]} AS h FROM v),
    b AS (SELECT doc_id, w * h > 1638400 AS big, CASE WHEN w * h > 1638400 THEN GREATEST(floor(w * SQRT(1638400.0::DOUBLE / (w * h))), 1) ELSE w END::BIGINT AS w,
            CASE WHEN w * h > 1638400 THEN GREATEST(floor(h * SQRT(1638400.0::DOUBLE / (w * h))), 1) ELSE h END::BIGINT AS h FROM a),
    c AS (SELECT doc_id, CASE WHEN big THEN {_cap('w', 'h')[0]} ELSE w END AS width, CASE WHEN big THEN {_cap('w', 'h')[1]} ELSE h END AS height FROM b)
    SELECT doc_id, width::BIGINT AS width, height::BIGINT AS height FROM c UNION ALL SELECT doc_id, w, h FROM s WHERE w = 0 OR h = 0""",
)
def image_target_size(spark, sf):
    s = spark.sql(SIZES, documents=table(spark, sf, "documents"))
    return s.select("doc_id", im.target_size(F.col("w"), F.col("h")).alias("t")).select("doc_id", "t.width", "t.height")


@query(
    "image_bounded_size",
    f"""WITH s AS ({SIZES.format(documents='documents')}), v AS (SELECT doc_id, w::DOUBLE AS w, h::DOUBLE AS h FROM s),
    a AS (SELECT doc_id, CASE WHEN w * h > 1000000 THEN floor(w * SQRT(1000000.0::DOUBLE / (w * h))) ELSE w END AS w, CASE WHEN w * h > 1000000 THEN floor(h * SQRT(1000000.0::DOUBLE / (w * h))) ELSE h END AS h FROM v),
    b AS (SELECT doc_id, CASE WHEN w * h < 10000 AND w * h > 0 THEN floor(w * SQRT(10000.0::DOUBLE / (w * h))) ELSE w END AS w, CASE WHEN w * h < 10000 AND w * h > 0 THEN floor(h * SQRT(10000.0::DOUBLE / (w * h))) ELSE h END AS h FROM a)
    SELECT doc_id, CASE WHEN w > 0 AND h > 0 AND GREATEST(w, h) / LEAST(w, h) >= 200 THEN LEAST(w, h * 199) ELSE w END::BIGINT AS width,
           CASE WHEN w > 0 AND h > 0 AND GREATEST(w, h) / LEAST(w, h) >= 200 THEN LEAST(h, w * 199) ELSE h END::BIGINT AS height FROM b""",
)
def image_bounded_size(spark, sf):
    s = spark.sql(SIZES, documents=table(spark, sf, "documents"))
    return s.select("doc_id", im.bounded_size(F.col("w"), F.col("h"), 10000, 1000000).alias("t")).select("doc_id", "t.width", "t.height")
