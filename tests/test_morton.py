from geoloom.plans import QUERIES


def test_morton_takes_all_orders(spark, tmp_path):
    """Order keys beyond 31 bits of their product: every row has its code."""
    keys = [1, 20505, 20506, 600_000, 2**31 - 1]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["id"]: r["code"] for r in QUERIES["h31_morton_all"](spark, str(tmp_path)).collect()}
    code = lambda x, y: sum((x >> b & 1) << 2 * b + 1 | (y >> b & 1) << 2 * b for b in range(31))
    assert got == {k: code(k * 7919 % 2**31, k * 104729 % 2**31) for k in keys}
