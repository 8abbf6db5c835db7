"""Centroid clustering of embedding vectors in integers, with JVM expressions only.

A vector counts if it has exactly ``DIMENSIONS`` components, none null or non-finite; other rows, null arrays too, get no row in the
result.  Component x becomes floor(1024 * x); beyond ``BOUND`` (2^27, that is 131,072 before scaling) it becomes the bound, so that every
squared distance fits in 64 bits.  A round is one job: ``zip_with`` and ``aggregate`` make the squared distances to literal centroid arrays,
``array_min`` of (distance, number) picks the centroid (ties: the smaller number), and one sum a column, partial in each task, gives the
next centroids.  What reaches the driver in a round is one row a centroid, whatever the number of vectors.

The integers are written once to the shared folder and read by every round, so a lost executor costs its tasks alone.  Fewer kept vectors
than centroids: each is a centroid.  Repeated rows are rows of their own; among equal ids the lesser vector comes first as a starting
centroid, and rows without an id come last.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseaudit.llm.common import Scratch

DIMENSIONS, CENTROIDS, ROUNDS, SCALE, BOUND = 64, 8, 10, 1024, 1 << 27
MOST = (1 << 63) - 1


def integers(vectors: DataFrame, column: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id and v (array of long) of the rows that count."""
    x = F.col(column)
    good = (F.size(x) == dimensions) & F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    scaled = F.transform(x, lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(float(BOUND))), F.lit(float(-BOUND)))))
    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"))


def start(kept: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The vectors with the least hashes of ``seed:vec_id``: at most k rows."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r["v"] for r in kept.select("v", key.alias("key")).orderBy(F.asc_nulls_last("key"), "v").limit(k).collect()]


def nearest(centroids: list[list[int]]) -> Column:
    """Struct (distance, cluster) of the nearest centroid of ``v``."""

    def distance(c: list[int]) -> Column:
        literal = F.expr(f"array({', '.join(f'{x}L' for x in c)})")
        return F.aggregate(F.zip_with("v", literal, lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, x: s + x)

    return F.array_min(F.array(*[F.struct(distance(c).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centroids)]))


def step(kept: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids after one round: floors of the means of their vectors; those without vectors stay."""
    dimensions = len(centroids[0])
    sums = kept.select(nearest(centroids)["cluster"].alias("cluster"), "v").groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(dimensions)])
    out = list(centroids)
    for r in sums.collect():
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dimensions)]
    return out


def cluster(vectors: DataFrame, column: str = "embedding", dimensions: int = DIMENSIONS, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and centroid of every vector that counts."""
    scratch = Scratch(vectors.sparkSession)
    kept = scratch.cut(integers(vectors, column, dimensions))
    centroids = start(kept, k, seed)
    for _ in range(rounds if centroids else 0):
        centroids = step(kept, centroids)
    # An empty table has no centroids; its result has the same columns.
    centroids = centroids or [[0] * dimensions]
    assigned = scratch.cut(kept.select("vec_id", nearest(centroids).alias("m")).select("vec_id", "m.cluster", "m.distance"))
    scratch.free(kept)
    inertia = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}

    def of_cluster(values: list[Column]) -> Column:
        return F.element_at(F.array(*values), F.col("cluster") + 1)

    return assigned.select(
        "vec_id", "cluster", "distance",
        of_cluster([F.lit(min(inertia.get(i, 0), MOST)).cast("long") for i in range(len(centroids))]).alias("cluster_inertia"), F.lit(min(sum(inertia.values()), MOST)).cast("long").alias("inertia"),
        of_cluster([F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids]).alias("centroid_sha256"),
        of_cluster([F.expr(f"array({', '.join(f'{x}L' for x in c)})") for c in centroids]).alias("centroid"),
    )


def _sql(dimensions: int = DIMENSIONS, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 3) -> str:
    """The same in DuckDB SQL over rows (vector, place, component), a pair of tables for each round."""
    parts = [
        f"""kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions})""",
        f"e AS MATERIALIZED (SELECT vec_id, unnest(v) AS x, unnest(range({dimensions})) AS i FROM kept)",
        f"first AS (SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, v FROM (SELECT v, sha256(concat('{seed}:', vec_id)) AS h FROM kept ORDER BY h LIMIT {k}) q)",
        f"c0 AS MATERIALIZED (SELECT cluster, unnest(v) AS x, unnest(range({dimensions})) AS i FROM first)",
    ]
    for n in range(rounds + 1):
        parts.append(f"""a{n} AS MATERIALIZED (SELECT vec_id, cluster, d FROM (SELECT e.vec_id, c.cluster, sum((e.x - c.x) * (e.x - c.x)) AS d FROM e JOIN c{n} c ON e.i = c.i GROUP BY 1, 2) q
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) = 1)""")
        if n < rounds:
            parts.append(f"""c{n + 1} AS MATERIALIZED (SELECT cluster, i, CAST((s - ((s % m) + m) % m) // m AS BIGINT) AS x FROM (SELECT a.cluster, e.i, sum(e.x) AS s, count(*) AS m FROM a{n} a JOIN e ON a.vec_id = e.vec_id GROUP BY 1, 2) q
  UNION ALL SELECT cluster, i, x FROM c{n} WHERE cluster NOT IN (SELECT cluster FROM a{n}))""")
    return f"""WITH {', '.join(parts)}, h AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY 1)
SELECT a.vec_id, CAST(a.cluster AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} a JOIN h ON a.cluster = h.cluster"""


SQL = _sql()
