import hashlib

from pyspark.sql import functions as F

from quillspark.operators import integrity as I


def plain(rows, start="genesis"):
    out, before = [], start
    for data in rows:
        out.append((before, before := hashlib.sha256(f"{before}:{data or ''}".encode()).hexdigest()))
    return out


def test_a_hot_key_is_a_plain_fold(spark):
    """One key holds nearly all rows; its chain streams through a task, and many tasks verify it."""
    n = 120_000
    rows = spark.range(n).selectExpr("if(id % 1000 = 7, id, -1) AS k", "(id * 7919) % 1000003 AS at", "concat('d', id) AS data").repartition(6)
    chain = I.build_chain(rows, "k", ["at"], "data", b"s").cache()
    hot = sorted((r["at"], r["data"], r["previous_hash"], r["chain_hash"]) for r in chain.where("k = -1").collect())
    assert len(hot) == n - n // 1000 and [h[2:] for h in hot] == plain([h[1] for h in hot])
    checked = {r["k"]: (r["n"], r["valid"]) for r in I.verify_chain(chain, "k", ["at"], "data", b"s").collect()}
    assert checked[-1] == (len(hot), True) and all(v == (1, True) for k, v in checked.items() if k != -1)
    middle = hot[len(hot) // 2]
    broken = {
        "data": chain.withColumn("data", F.when(F.col("data") == middle[1], "other").otherwise(F.col("data"))),
        "gone": chain.where(F.col("data") != middle[1]),
        "first gone": chain.where(F.col("data") != hot[0][1]),
        "moved": chain.withColumn("at", F.when(F.col("data") == middle[1], -5).otherwise(F.col("at"))),
        "signature": chain.withColumn("signature", F.when(F.col("data") == middle[1], "x").otherwise(F.col("signature"))),
    }
    for why, bad in broken.items():
        wrong = [r["k"] for r in I.verify_chain(bad, "k", ["at"], "data", b"s").where("NOT valid").collect()]
        assert wrong == [-1], why
    # The verification deals the hot key out: no task of its shuffle sees nearly all rows.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so little is put together else
    slim = chain.repartitionByRange("k", "at").groupBy(F.spark_partition_id()).count()
    assert slim.agg(F.max("count")).first()[0] < 0.6 * n
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    chain.unpersist()


def test_chains_go_on_from_their_heads(spark):
    rows = [(1, 1, "a"), (1, 2, "b"), (None, 1, "x"), (2, 1, None), (1, 3, "c"), (None, 5, "y"), (3, 9, "new")]
    frame = lambda part: spark.createDataFrame(part, "k long, i int, data string")
    first = I.build_chain(frame(rows[:4]), "k", ["i"], "data")
    later = I.build_chain(frame(rows[4:]), "k", ["i"], "data", heads=I.heads(first, "k", ["i"]))
    both, whole = first.unionByName(later), I.build_chain(frame(rows), "k", ["i"], "data")
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert key(both) == key(whole) and both.columns == ["k", "i", "data", "previous_hash", "chain_hash", "signature"]
    assert {(r["k"], r["n"], r["valid"]) for r in I.verify_chain(both, "k", ["i"], "data").collect()} == {(1, 3, True), (None, 2, True), (2, 1, True), (3, 1, True)}
    assert I.verify_chain(whole.limit(0), "k", ["i"], "data").count() == 0 and I.build_chain(frame(rows[:0]), "k", ["i"], "data").count() == 0
