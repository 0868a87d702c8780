"""An index of vectors for searches by inner product: a coarse quantiser, inverted lists of all rows, probing, an exact mode.

The quantiser is fitted on at most about SAMPLE_ROWS rows, drawn by a hash of their ids; every row is then listed with its
nearest centroid. A list is stored in slices of about SLICE_ROWS rows, dealt by a hash, so a list that holds a third of all
rows is many slices. A search ranks the lists of each query by an upper bound of what they may hold, probes the best ones (as many
as a calibration on a bounded sample of rows finds to hold the wanted share of matches), and the exact mode then looks into every other list whose bound reaches the query's k-th best: <q, x> is at most
<q, c> + |q| r for a row x within r of its list's centroid c.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.operators.retrieve import read, top_k
from lodeline.plans.shared import bound_batches, discard, join_checked, materialise, shared_dir

#: Rows that the quantiser is fitted on, about; rows of a slice; queries that meet a slice in one task.
SAMPLE_ROWS, SLICE_ROWS, QUERY_ROWS = 20_000, 4096, 4096
#: Lists: so many for the square root of the rows, within these limits.
LISTS_A_ROOT, LEAST_LISTS, MOST_LISTS = 0.5, 4, 4096
#: Lists that an approximate search looks into unless ``calibrate`` finds another number: this share.
PROBED_SHARE = 0.5
#: Of the true matches of a calibration's queries, so many lie in the lists probed from then on; and its queries, about.
COVERED, CALIBRATION_ROWS = 0.95, 200
#: Scores are rounded to so many places, so a bound may be short by as much.
PLACES = 6


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float) if len(vectors) else np.zeros((0, 0))


class VectorIndex:
    """Lists (list, slice, vec_id, embedding) and a row for each list (list, centroid, radius, n, slices), as tables below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        self.rows, self.lists = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/lists")
        known = self.lists.orderBy("list").collect()  # MOST_LISTS rows at most
        self.names = np.array([r["list"] for r in known], np.int64)
        self.centroids = np.array([r["centroid"] for r in known], float)
        self.radii = np.array([r["radius"] for r in known], float)
        self.probed = max(1, int(PROBED_SHARE * len(self.names)))

    @classmethod
    def build(cls, rows: DataFrame, path: str, seed: int = 7) -> VectorIndex:
        """Index (vec_id, embedding); rows without a vector are left out, repeated rows are listed each. Needs a row."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        spark = rows.sparkSession
        bound_batches(spark)
        given = rows.where(F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
        n = given.count()
        wanted = int(min(MOST_LISTS, max(LEAST_LISTS, LISTS_A_ROOT * n**0.5)))
        drawn = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE_ROWS / max(n, 1)))
        sample = given.where(drawn) if n > SAMPLE_ROWS else given
        vectors = materialise(sample.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")), "vector-sample")
        model = KMeans(k=wanted, seed=seed, maxIter=15).fit(vectors)
        centroids = np.array(model.clusterCenters(), float)
        discard(vectors)
        squares = (centroids**2).sum(1)

        def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    x = _matrix(batch["embedding"])
                    at = (squares - 2 * x @ centroids.T).argmin(1)
                    yield batch.assign(list=at.astype(np.int32), away=np.sqrt(((x - centroids[at]) ** 2).sum(1)))

        listed = materialise(given.mapInPandas(nearest, "vec_id long, embedding array<float>, list int, away double"), "vector-listed")
        about = listed.groupBy("list").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
        about = about.withColumn("slices", F.ceil(F.col("n") / SLICE_ROWS).cast("int"))
        centres = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>")
        about.join(F.broadcast(centres), "list").select("list", "centroid", "radius", "n", "slices").coalesce(1).write.parquet(f"{path}/lists")
        sliced = join_checked(listed, spark.read.parquet(f"{path}/lists").select("list", "slices"), "list").withColumn("slice", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("slices")).cast("int"))
        sliced.select("list", "slice", "vec_id", "embedding").repartition("list", "slice").sortWithinPartitions("list", "slice").write.parquet(f"{path}/rows")
        discard(listed)
        return cls(spark, path)

    def bounds(self, queries: DataFrame) -> DataFrame:
        """query_id, embedding, list, bound, place: each list's bound, and its place among a query's lists."""
        names, centroids, radii = self.names, self.centroids, self.radii

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for i in range(0, len(batch), 64):
                    part = batch.iloc[i : i + 64]
                    q = _matrix(part["embedding"])
                    near = q @ centroids.T
                    bound = near + np.sqrt((q**2).sum(1))[:, None] * radii[None, :]
                    place = (-near).argsort(1, kind="stable").argsort(1)
                    m = len(names)
                    yield pd.DataFrame({"query_id": np.repeat(part["query_id"].to_numpy(), m), "list": np.tile(names, len(part)), "bound": bound.ravel(), "place": place.ravel()})

        return queries.mapInPandas(run, "query_id long, list int, bound double, place int")

    def calibrate(self, k: int, covered: float = COVERED) -> int:
        """Set ``probed`` so that the lists hold this share of the k best, by the exact matches of about CALIBRATION_ROWS rows drawn by a hash."""
        n = self.lists.agg(F.sum("n")).first()[0]
        drawn = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, CALIBRATION_ROWS / max(n, 1)))
        queries = materialise(self.rows.where(drawn).select(F.col("vec_id").alias("query_id"), "embedding").dropDuplicates(["query_id"]), "vector-calibration")
        matches = self.search(queries, k, exact=True).select("query_id", "vec_id").join(self.rows.select("vec_id", "list"), "vec_id")
        place = matches.join(self.bounds(queries), ["query_id", "list"]).agg(F.percentile("place", covered)).first()[0]
        discard(queries)
        self.probed = self.probed if place is None else min(len(self.names), int(place) + 1)
        return self.probed

    def _scored(self, queries: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
        """query_id, vec_id, score: the k best of each wanted (query_id, list) and slice."""
        pairs = materialise(wanted.select("query_id", "list"), "vector-wanted")
        asked = pairs.groupBy("list").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("parts"))
        sizes = materialise(self.lists.select("list", "slices").join(asked, "list"), "vector-parts")
        left = join_checked(pairs, sizes, "list").join(queries, "query_id")
        left = left.withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        right = join_checked(self.rows, sizes.select("list", "parts"), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        keys = ["list", "slice", "part"]

        def score(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(x):
                return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
            matrix, vec = _matrix(x["embedding"]).T, x["vec_id"].to_numpy(np.int64)
            out = []
            for i in range(0, len(q), 256):
                part = q.iloc[i : i + 256]
                names = part["query_id"].to_numpy(np.int64)
                products = np.round(_matrix(part["embedding"]) @ matrix, PLACES)
                products[names[:, None] == vec[None, :]] = -np.inf
                m = min(k, len(vec))
                least = -np.partition(-products, m - 1, axis=1)[:, m - 1]
                row, at = np.nonzero((products >= least[:, None]) & np.isfinite(products))
                found = pd.DataFrame({"query_id": names[row], "vec_id": vec[at], "score": products[row, at]})
                out.append(found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k))
            return pd.concat(out)

        found = left.select(*keys, "query_id", "embedding").groupBy(*keys).cogroup(right.select(*keys, "vec_id", "embedding").groupBy(*keys)).applyInPandas(score, "query_id long, vec_id long, score double")
        found = materialise(top_k(found, k, key="vec_id").drop("rank"), "vector-found")
        discard(pairs, sizes)
        return found

    def search(self, queries: DataFrame, k: int, exact: bool = False, probed: int | None = None) -> DataFrame:
        """query_id, vec_id, score, rank of (query_id, embedding); a row is no match of itself, ties by the least vec_id.

        Query ids are distinct. Each query looks into ``probed`` lists; the exact mode into all that may hold one of its k best.
        """
        probed = probed or self.probed
        queries = queries.where(F.col("embedding").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), "embedding")
        bounds = materialise(self.bounds(queries), "vector-bounds")
        found = self._scored(queries, bounds.where(F.col("place") < probed), k)
        if exact:
            worst = found.groupBy("query_id").agg(F.count("*").alias("m"), F.min("score").alias("worst")).where(F.col("m") >= k)
            more = bounds.where(F.col("place") >= probed).join(worst, "query_id", "left").where(F.col("worst").isNull() | (F.col("bound") >= F.col("worst") - 10.0**-PLACES))
            found = found.unionByName(self._scored(queries, more, k))
        return top_k(found, k, key="vec_id").select("query_id", "vec_id", "score", "rank")


def _indexed(spark: SparkSession, sf_dir: str) -> tuple[VectorIndex, DataFrame]:
    import uuid

    rows = read(spark, sf_dir, "embeddings")
    return VectorIndex.build(rows, f"{shared_dir(spark)}/lodeline/vector-index-{uuid.uuid4().hex}"), rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id").select("query_id", "embedding")


def q_vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all rows for every twentieth, by the exact mode of the index."""
    index, queries = _indexed(spark, sf_dir)
    return index.search(queries, 10, exact=True)


def q_vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the index, queries, and whether probing finds nine tenths of the exact mode's ten best."""
    index, queries = _indexed(spark, sf_dir)
    exact = index.search(queries, 10, exact=True).select("query_id", "vec_id")
    index.calibrate(10)
    found = index.search(queries, 10).select("query_id", "vec_id", F.lit(1).alias("hit"))
    recall = exact.join(found, ["query_id", "vec_id"], "left").agg(F.count_distinct("query_id").alias("queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("recalled"))
    return recall.crossJoin(index.rows.agg(F.count("*").alias("indexed"))).select("indexed", "queries", "recalled")


QUERIES = {n.removeprefix("q_"): f for n, f in list(globals().items()) if n.startswith("q_")}
ORACLE = {
    "vector_index_topk": """SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
SELECT q.vec_id AS query_id, e.vec_id, round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id)) WHERE rank <= 10""",
    "vector_index_recall": "SELECT (SELECT count(*) FROM embeddings) AS indexed, count(*) AS queries, true AS recalled FROM embeddings WHERE vec_id % 20 = 0",
}
