"""Nearest neighbours by randomly rotated one-bit codes: estimates from packed bits and correction scalars choose, by their error bounds, the vectors that are compared exactly."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.common import arrow_map, materialize, read_table

NEAREST = 20
#: Vectors are padded by zeros to so many times their length before they are rotated, so a code has so many bits a component (rounded up to whole words).
PAD, WORD = 4, 64
#: Standard deviations of the estimate's error that count as possible.
EPSILON = 3.0
#: Components of a block of vectors and of queries: what one task holds, some 80 and 10 MB. Smaller tables are dealt into SPREAD blocks of LEAST rows at least.
VECTORS, QUERIES, LEAST, SPREAD = 1 << 23, 1 << 20, 1 << 11, 8
#: Codes and queries whose estimates a task holds at once: 16 MB of floats.
CODES_AT_ONCE, QUERIES_AT_ONCE = 1 << 14, 1 << 8
SEED = 29


@lru_cache(maxsize=4)
def rotation(length: int) -> np.ndarray:
    """length x bits: the first rows of a random rotation, the same in every task, so padding needs no zeros."""
    bits = -(-PAD * length // WORD) * WORD
    q, r = np.linalg.qr(np.random.default_rng(SEED + length).standard_normal((bits, length)))
    return (q * np.sign(np.diag(r))).T


def unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors at length 1, and their lengths; none may be zero. Scaled first, so that squares neither overflow nor vanish."""
    most = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / most
    norm = np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
    return scaled / norm, (most * norm)[:, 0]


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows x words of 64 signs of the rotated vector), factors (inner product of a rotated unit vector with its code, also of length 1), lengths."""
    ones, norms = unit(vectors)
    turned = ones @ rotation(vectors.shape[1])
    bits = turned.shape[1]
    packed = np.packbits(turned > 0, axis=1, bitorder="little").view(np.uint64)
    return packed, np.abs(turned).sum(axis=1) / np.sqrt(bits), norms


def signs_of(codes: np.ndarray) -> np.ndarray:
    """Packed codes as rows of 1 and -1."""
    return np.unpackbits(codes.view(np.uint8), axis=1, bitorder="little").astype(np.float32) * 2 - 1


def corrections(factors: np.ndarray, norms: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two scalars for each code: what turns the product of a rotated unit query and the code's signs into an unbiased estimate of its product with the vector,
    and how far that may be off: EPSILON deviations, each sqrt(1/f^2 - 1) / sqrt(bits - 1) of the vector's length for a factor f, and the rounding of single floats."""
    return norms / (factors * np.sqrt(bits)), norms * (EPSILON * np.sqrt(np.maximum(0.0, 1 / factors**2 - 1) / (bits - 1)) + 1e-5)


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of query with rows, added component by component, so that equal vectors give equal sums wherever they stand."""
    return np.cumsum(vectors * query, axis=1)[:, -1]


def best_in_block(queries: dict, block: dict, nearest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query: positions in block, and inner products, of its nearest there: exact but for what the bounds miss.

    Codes come in parts. In the first, the nearest by estimate are compared exactly; the least product of the nearest so far is a floor, and
    whatever reaches it by estimate plus bound is compared. queries and block: row (unique) and vectors; block has id, codes, factors and norms as well.
    """
    units, lengths = unit(queries["vectors"])
    turned = (units @ rotation(units.shape[1])).astype(np.float32)
    scale, off = (x.astype(np.float32) for x in corrections(block["factors"], block["norms"], turned.shape[1]))
    order = np.argsort(block["row"])
    at = order[np.minimum(np.searchsorted(block["row"], queries["row"], sorter=order), len(order) - 1)]
    own = np.where(block["row"][at] == queries["row"], at, -1)
    best = [(np.empty(0, np.int64), np.empty(0))] * len(turned)

    def take(i: int, positions: np.ndarray) -> None:
        place = np.concatenate([best[i][0], positions])
        score = np.concatenate([best[i][1], exact(queries["vectors"][i], block["vectors"][positions])])
        kept = np.lexsort((block["id"][place], -score))[:nearest]
        best[i] = place[kept], score[kept]

    for start in range(0, len(block["row"]), CODES_AT_ONCE):
        part = slice(start, start + CODES_AT_ONCE)
        signs = signs_of(block["codes"][part]).T
        for low in range(0, len(turned), QUERIES_AT_ONCE):
            guesses = turned[low : low + QUERIES_AT_ONCE] @ signs * scale[part]
            for i, guess in enumerate(guesses, low):
                if 0 <= own[i] - start < len(guess):
                    guess[own[i] - start] = -np.inf
                first = np.empty(0, np.int64)
                if len(best[i][0]) < nearest:
                    first = np.argpartition(-guess, min(nearest, len(guess)) - 1)[:nearest]
                    first = first[first + start != own[i]]
                    take(i, first + start)
                # ~(<) keeps what can't be compared
                floor = best[i][1][-1] / lengths[i] if len(best[i][0]) == nearest else -np.inf
                maybe = np.flatnonzero(~(guess + off[part] < floor)) if floor > -np.inf else np.arange(len(guess))
                maybe = np.setdiff1d(maybe, first, assume_unique=True)
                take(i, maybe[maybe + start != own[i]] + start)
    return best


def _matrix(column: pa.ChunkedArray | pa.Array, length: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)


def _encoded(batch: pa.RecordBatch) -> dict:
    """Codes of one batch, vectors of each length apart."""
    lengths = batch.column("_length").to_numpy()
    codes: list = [None] * len(lengths)
    factors, norms = np.zeros(len(lengths)), np.zeros(len(lengths))
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        packed, factors[at], norms[at] = encode(_matrix(batch.column("_vector").take(pa.array(at)), int(n)))
        for i, row in zip(at, packed):
            codes[i] = row.tobytes()
    return {"_code": pa.array(codes, pa.binary()), "_factor": pa.array(factors), "_norm": pa.array(norms)}


_CODES = [T.StructField("_code", T.BinaryType()), T.StructField("_factor", T.DoubleType()), T.StructField("_norm", T.DoubleType())]


def encoded(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """_row (unique), _id, _vector (doubles), _length, _code, _factor and _norm of each vector that takes part: all components finite, not all zero, and an id."""
    usable = F.forall("_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("_vector", lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_vector")).where(F.col("_id").isNotNull() & F.col("_vector").isNotNull())
    rows = rows.where(usable).withColumn("_length", F.size("_vector")).withColumn("_row", F.monotonically_increasing_id())
    return arrow_map(rows, _CODES, _encoded)


def _searched(nearest: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, queries: pa.Table, block: pa.Table) -> pa.Table:
        schema = pa.schema([("_row", pa.int64()), ("query_id", pa.int64()), ("_found", pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())])))])
        if not queries.num_rows or not block.num_rows:
            return schema.empty_table()
        length = key[0].as_py()
        codes = np.frombuffer(b"".join(block["_code"].to_pylist()), np.uint64).reshape(block.num_rows, -1)
        ids = block["_id"].to_numpy()
        own = {"row": block["_row"].to_numpy(), "id": ids, "vectors": _matrix(block["_vector"], length), "codes": codes, "factors": block["_factor"].to_numpy(), "norms": block["_norm"].to_numpy()}
        asked = {"row": queries["_row"].to_numpy(), "vectors": _matrix(queries["_vector"], length)}
        best = best_in_block(asked, own, nearest)
        found = [[{"score": float(s), "vec_id": int(ids[i])} for i, s in zip(*b)] for b in best]
        return pa.table([queries["_row"].combine_chunks(), queries["_id"].combine_chunks(), pa.array(found, schema.field("_found").type)], schema=schema)

    return run


def blocks_of(rows: int, most: int) -> int:
    """Blocks of most rows each; small tables get up to SPREAD, of LEAST rows at least, so that they keep some tasks busy."""
    return max(-(-rows // most), min(SPREAD, -(-rows // LEAST)), 1)


def nearest_by_codes(vectors: DataFrame, is_query: Callable[[Column], Column], nearest: int = NEAREST, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for each query the nearest other rows by inner product, ties to the smaller id.

    is_query tells from the id whether a row is a query. Every query is held against every row, block by block: a cell of a block of queries and one of vectors is a task, so none grows
    with the table, and shuffled rows are the vectors times the blocks of queries. A cell gives the nearest of each
    query in it, in one row; the best of those are taken for each query. Only vectors of one length are compared.
    Rows without an id, and vectors that are null, zero or hold null or infinite components or NaN, take no part. A repeated row is a
    candidate of its own, even to its repeat. An empty table gives none; other columns are ignored.
    """
    index = materialize(encoded(vectors, key, vector), "bit-codes")
    asked = index.where(is_query(F.col("_id"))).select("_row", "_id", "_vector", "_length")
    n, longest = index.agg(F.count(F.lit(1)), F.coalesce(F.max("_length"), F.lit(1))).first()
    deep, wide = blocks_of(n, max(1, VECTORS // longest)), -(-asked.count() // max(1, QUERIES // longest)) or 1
    rows = index.withColumn("_b", F.pmod(F.xxhash64("_row"), F.lit(deep))).withColumn("_q", F.explode(F.expr(f"sequence(0L, {wide - 1}L)")))
    asks = asked.withColumn("_q", F.pmod(F.xxhash64("_row"), F.lit(wide))).withColumn("_b", F.explode(F.expr(f"sequence(0L, {deep - 1}L)")))
    cell = ["_length", "_q", "_b"]
    cells = asks.groupBy(*cell).cogroup(rows.groupBy(*cell)).applyInArrow(_searched(nearest), "_row long, query_id long, _found array<struct<score double, vec_id long>>")
    best = cells.select("_row", "query_id", F.explode("_found").alias("_f")).select("_row", "query_id", "_f.*")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("_row").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def op13_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all others."""
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_by_codes(vectors, lambda i: i % 20 == 0)


#: Exact search; components are multiplied and added in their order, as exact() does.
ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda x: x[1] * x[2]), lambda a, b: a + b) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM scored
QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 20
"""
