"""Centroid clustering of integer vectors in JVM expressions: distances to literal centroids, codegen sums for the new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import discard, written

DIMENSIONS, SCALE, CLUSTERS, ROUNDS, SALT = 64, 1024, 8, 10, "3:"
#: Components from here on raise an error: below it no squared distance over 64 components passes 62 bits.
LARGEST = 1 << 27


def whole_components(vector: Column, dimensions: int = DIMENSIONS, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of each component; null for a vector of another length or with a null or non-finite component."""
    v = vector.cast("array<double>")
    usable = (F.size(v) == dimensions) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    q = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x))
    too_large = F.exists(q, lambda x: ~x.between(1 - LARGEST, LARGEST - 1))
    return F.when(usable, F.when(too_large, F.raise_error(F.lit(f"a component times {scale} is {LARGEST} or more")).cast("array<bigint>")).otherwise(q))


def nearest(centroids: list[list[int]], q: str = "q") -> Column:
    """(distance, cluster) of the centroid nearest to the column ``q``, the smaller number where two are as near."""
    # as SQL text: a round names some hundred numbers, and one call each to make them would take longer than small tables do
    each = [
        f"named_struct('distance', aggregate(zip_with({q}, array({', '.join(f'{x}L' for x in c)}), (a, b) -> (a - b) * (a - b)), 0L, (s, x) -> s + x), 'cluster', {k})"
        for k, c in enumerate(centroids)
    ]
    return F.expr(f"array_min(array({', '.join(each)}))")


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid replaced by the exact floor of the mean of its vectors; one without vectors stays.

    The sums are columns of one grouped aggregate with partials in each task; a row a cluster comes to the driver.
    """
    places = range(len(centroids[0]))
    at = vectors.select(nearest(centroids)["cluster"].alias("cluster"), "q")
    sums = at.groupBy("cluster").agg(F.expr("count(*) AS n"), F.expr(f"array({', '.join(f'sum(q[{k}])' for k in places)}) AS sums"))
    out = list(centroids)
    for r in sums.collect():
        out[r["cluster"]] = [s // r["n"] for s in r["sums"]]
    return out


def cluster_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, salt: str = SALT,
    dimensions: int = DIMENSIONS, scale: int = SCALE,
) -> DataFrame:
    """The rows with a usable vector, all their columns, and ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and
    ``centroid`` (unless the input has columns of these names).

    A vector counts if it has ``dimensions`` components, none null or non-finite; other rows go. Centroids start as the
    vectors with the smallest sha256 of ``salt`` and the id; null ids come last, and of equal hashes the smaller vector
    is first. Repeated rows count as often as they come. With fewer vectors than ``clusters`` there are as many
    centroids as vectors, and an empty table gives an empty table. Rounds end early once nothing moves.

    The integer vectors are written once, and each round reads them again: an executor that is lost costs its tasks only.
    Sums are exact to 2^36 vectors at the largest components, and to 2^52 at components as they are in unit vectors.
    """
    q = whole_components(F.col(f"`{vector_col}`"), dimensions, scale)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    vectors = written(df.select(row.alias("row"), F.col(f"`{id_col}`").cast("string").alias("id"), q.alias("q")).where("q is not null"), "vectors")
    seed = F.coalesce(F.sha2(F.concat(F.lit(salt), F.col("id")), 256), F.lit("none"))
    centroids = [r["q"] for r in vectors.select(seed.alias("seed"), "q").orderBy("seed", "q").limit(clusters).collect()]
    for _ in range(rounds if centroids else 0):
        before, centroids = centroids, moved(vectors, centroids)
        if centroids == before:
            break
    if not centroids:
        found = vectors.select("row", F.struct(F.lit(0).cast("bigint").alias("distance"), F.lit(0).alias("cluster")).alias("n"))
    else:
        found = vectors.select("row", nearest(centroids).alias("n"))
    found = written(found.select("row", "n.cluster", "n.distance"), "clusters")
    discard(vectors)
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    of = lambda values, kind: F.element_at(F.lit(values or [None]).cast(f"array<{kind}>"), F.col("cluster") + 1)
    added = {
        "cluster": F.col("cluster"), "distance": F.col("distance"),
        "cluster_inertia": of([sums.get(k, 0) for k in range(len(centroids))], "bigint"), "inertia": F.lit(sum(sums.values())).cast("bigint"),
        "centroid": of(centroids, "array<bigint>"),
    }
    return found.select(*[F.col("row").getField(c).alias(c) for c in df.columns], *[v.alias(k) for k, v in added.items() if k not in df.columns])


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def _sql(clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """DuckDB: a round is two common table expressions, nearest centroids and new ones."""
    near = """(SELECT vec_id, any_value(q) AS q, min(d * {n} + k) AS m FROM (
  SELECT v.vec_id, v.q, c.k, list_sum(list_transform(list_zip(v.q, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT AS d
  FROM v, c{r} AS c) GROUP BY vec_id)"""
    parts = [f"""v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, q) - 1 AS k, q AS c FROM (SELECT sha256('{SALT}' || vec_id) AS h, q FROM v) QUALIFY k < {clusters})"""]
    for r in range(rounds):
        parts.append(f"""a{r} AS MATERIALIZED {near.format(n=clusters, r=r)},
c{r + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(m.c, c.c) AS c FROM c{r} AS c LEFT JOIN (
    SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY pos)::BIGINT[] AS c FROM (
      SELECT k, pos, sum(x) AS s, count(*) AS n FROM (
        SELECT m % {clusters} AS k, unnest(q) AS x, generate_subscripts(q, 1) AS pos FROM a{r}) GROUP BY k, pos)
    GROUP BY k) AS m USING (k))""")
    return f"""WITH {", ".join(parts)},
last AS (SELECT vec_id, (m % {clusters})::INT AS cluster, (m // {clusters})::BIGINT AS distance FROM {near.format(n=clusters, r=rounds)})
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
       sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM last JOIN c{rounds} AS c ON c.k = last.cluster"""


#: DuckDB.
OP13_SQL = _sql()
