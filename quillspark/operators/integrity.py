"""Hash-chained, signed audit logs and export identifiers."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import scalars as X

GENESIS = "genesis"


def build_chain(rows: DataFrame, key: str, order: list[str], data: str, secret: bytes = b"", heads: DataFrame | None = None) -> DataFrame:
    """rows with previous_hash, chain_hash and signature; each key's rows are chained in order (then by data).

    A chain is sequential by nature, so a key's rows pass one task, sorted, and only the last hash is carried from one to
    the next: a key of any number of rows takes no more memory than a batch. Keys go in parallel. heads (key, chain_hash)
    are the last links of chains that rows continue; without one a chain starts anew. Null data counts as empty, and rows
    with a null key are a chain of their own.
    """
    kept = rows.withColumn("__head", F.lit(None).cast("string"))
    if heads is not None:
        last = heads.select(F.col(key).alias("__key"), F.col("chain_hash").alias("__head"))
        kept = rows.join(last, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")
    schema = T.StructType([*rows.schema.fields, T.StructField("previous_hash", T.StringType()), T.StructField("chain_hash", T.StringType())])
    names, genesis = rows.columns, GENESIS

    def run(batches):
        now, before, begun = None, genesis, False
        for batch in batches:
            previous, hashes = [], []
            for k, text, head in zip(*(batch.column(c).to_pylist() for c in (key, data, "__head"))):
                if not begun or k != now:
                    now, before, begun = k, head or genesis, True
                previous.append(before)
                before = hashlib.sha256(f"{before}:{text or ''}".encode()).hexdigest()
                hashes.append(before)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(previous, pa.string()), pa.array(hashes, pa.string())], names=schema.names)

    chained = kept.repartition(key).sortWithinPartitions(key, *order, data).mapInArrow(run, schema)
    return chained.withColumn("signature", X.hmac_sha256(F.col("chain_hash"), secret))


def heads(chained: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key and chain_hash of each chain's last row."""
    return chained.groupBy(key).agg(F.max_by("chain_hash", F.struct(*order)).alias("chain_hash"))


def verify_chain(rows: DataFrame, key: str, order: list[str], data: str, secret: bytes = b"") -> DataFrame:
    """For each key, its number of rows and whether links, hashes and signatures all hold.

    A row's own hash and signature follow from the row. Links are between neighbours, so rows are dealt by ranges of key
    and order, and a key with most of all rows is held by many tasks: each gives one row for a key, with its first and last
    link, and these few rows are held against each other.
    """
    own = (F.col("chain_hash") == X.chain_hash(F.col("previous_hash"), F.coalesce(data, F.lit("")))) & (F.col("signature") == X.hmac_sha256(F.col("chain_hash"), secret))
    slim = rows.select(key, *(c for c in order if c != key), "previous_hash", "chain_hash", F.coalesce(own, F.lit(False)).alias("__good"))
    schema = T.StructType([rows.schema[key], *(T.StructField(n, t) for n, t in (("part", T.IntegerType()), ("n", T.LongType()), ("good", T.BooleanType()), ("first", T.StringType()), ("last", T.StringType())))])

    def run(batches):
        part, run_, held = TaskContext.get().partitionId(), None, []
        for batch in batches:
            keys = batch.column(key)
            for i, (k, previous, own_hash, good) in enumerate(zip(keys.to_pylist(), *(batch.column(c).to_pylist() for c in ("previous_hash", "chain_hash", "__good")))):
                if run_ is None or run_[0] != k:
                    if run_ is not None:
                        held.append(run_)
                    run_ = [k, part, 0, True, previous, None, keys.slice(i, 1)]
                elif previous != run_[5]:
                    good = False
                run_[2:4] = run_[2] + 1, run_[3] and good
                run_[5] = own_hash
            if len(held) > 1000:
                yield packed(held)
                held = []
        if run_ is not None:
            yield packed([*held, run_])

    def packed(found):
        kinds = (pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.concat_arrays([x[6] for x in found]), *(pa.array([x[i] for x in found], t) for i, t in enumerate(kinds, 1))], names=schema.names)

    place = [F.col(key).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order)]
    runs = slim.repartitionByRange(*place).sortWithinPartitions(*place).mapInArrow(run, schema)
    before = F.coalesce(F.lag("last").over(Window.partitionBy(key).orderBy("part")), F.lit(GENESIS))
    linked = runs.withColumn("good", F.coalesce(F.col("good") & (F.col("first") == before), F.lit(False)))
    return linked.groupBy(key).agg(F.sum("n").alias("n"), F.bool_and("good").alias("valid"))


def decode_exports(ids: DataFrame, column: str, exports: DataFrame, prefix: str, secret: bytes) -> DataFrame:
    """ids with found, not_in_library, foreign or invalid."""
    status = X.export_id_status(F.col(column), prefix, secret)
    known = exports.select(F.col("export_id").alias(column)).distinct().withColumn("__known", F.lit(True))
    return ids.join(known, column, "left").withColumn("result", F.when(status != "ours", status).when(F.col("__known"), "found").otherwise("not_in_library")).drop("__known")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of new, and those of old whose key new does not have; columns a side lacks are null."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)
