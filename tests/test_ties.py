"""Fits that leave nothing, and centres and axes that are alike, against the SQL: rounding has no say."""

from __future__ import annotations

import duckdb
import pytest

from lodestone.queries import ORACLE_SQL, QUERIES

#: Images of sf0.1 whose fits were settled by rounding.
IMAGES = {"paint_ladder": (68, 1141), "radial_fit": (612, 666, 1169, 1712), "region_axes": (68, 612, 666, 1141, 1169, 1712)}


@pytest.mark.parametrize("name", sorted(IMAGES))
def test_exact_fits_equal_the_sql(spark, tmp_path, name):
    few = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where(f"vec_id in {IMAGES[name]}")
    few.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    # the engines round alike, so that values are equal as they stand
    rows = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    plain = lambda r: tuple(v if isinstance(v, str) or v is None else float(v) + 0.0 for v in r)
    assert sorted(map(plain, df.collect()), key=str) == sorted(map(plain, rows), key=str)


def test_a_ramp_that_fits_in_full_is_linear(spark, tmp_path):
    few = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("vec_id in (68, 1141)")
    few.write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {(r["img_id"], r["label"]): r["model"] for r in QUERIES["paint_ladder"](spark, str(tmp_path)).collect()}
    assert found[68, 0] == found[1141, 0] == "linear"
