"""Clusters of vectors."""

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hilite.operators.order import positions
from hilite.operators.skew import join_by_frequency
from hilite.session import written

NOISE = -1


def zscored(df: DataFrame, id_: str, vector: str) -> DataFrame:
    """(id, z): each vector with its components z-scored over all rows."""
    stats = df.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    # a row for each component
    means = stats.agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "sd"))).alias("s")).first().s
    m, d = (F.array(*(F.lit(r[c]) for r in means)) for c in ("mean", "sd"))
    score = F.zip_with(F.zip_with(F.col(vector).cast("array<double>"), m, lambda x, y: x - y), d, lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0)))
    return df.select(id_, score.alias("z"))


def kmeans(df: DataFrame, id_: str, vector: str, k: int, *, seed: int = 1) -> DataFrame:
    """(id, cluster) by k-means of z-scored vectors from random centres."""
    data = zscored(df, id_, vector).select(id_, array_to_vector("z").alias("__v"))
    return KMeans(k=k, seed=seed, initMode="random", featuresCol="__v", predictionCol="cluster").fit(data).transform(data).select(id_, "cluster")


def lloyd(x: np.ndarray, weight: np.ndarray, k: int, *, seed: int = 1, tolerance: float = 1e-4, block: int = 50_000) -> np.ndarray:
    """The cluster of each of some different vectors that stand for weight rows each: from k random rows, all of them where there are fewer, until the squared error moves by less than tolerance."""
    k = min(k, len(x))
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False, p=weight / weight.sum())].copy()
    before = np.inf
    while True:
        far = (centres * centres).sum(1)
        own = np.concatenate([(far - 2 * x[i : i + block] @ centres.T).argmin(1) for i in range(0, len(x), block)])
        size = np.bincount(own, weight, k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x * weight[:, None])
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], centres)
        error = float((weight * ((x - centres[own]) ** 2).sum(1)).sum())
        if abs(before - error) < tolerance:
            return own
        before = error


def vector_key(vector: Column) -> Column:
    """A key of 128 bits of a vector, the same for equal ones and null for none; rows are joined by it, so that their vectors need not leave their tasks."""
    v = vector.cast("array<double>")
    hashes = F.concat(F.lpad(F.hex(F.xxhash64(v)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), v)), 16, "0"))
    # these hashes pass over null components
    return F.when(F.size(F.array_compact(v)) == F.size(v), hashes).when(v.isNotNull(), F.md5(v.cast("string")))


def clusters_of_keys(df: DataFrame, cid: str, vector: str, numbers: list[int], *, seed: int = 1) -> DataFrame:
    """(__cid, __key, cluster_num, topic): for each video, different vector by its vector_key and number of clusters, the cluster from 0; see clusterings. A table in the shared folder."""
    rows = df.where(F.col(cid).isNotNull() & F.col(vector).isNotNull()).withColumn("__v", F.col(vector).cast("array<double>"))
    different = rows.groupBy(F.col(cid).alias("__cid"), F.col("__v").alias("__vector")).agg(F.count(F.lit(1)).cast("double").alias("n")).withColumn("__key", vector_key(F.col("__vector")))
    each = written(different, "vectors").withColumn("cluster_num", F.explode(F.array(*map(F.lit, numbers))))
    kind = different.schema["__cid"].dataType.simpleString()

    def run(g: pd.DataFrame) -> pd.DataFrame:
        order = sorted(range(len(g)), key=lambda i: tuple(g["__vector"].iloc[i]))  # whatever order rows come in
        g = g.iloc[order]
        x, n = np.array(g["__vector"].tolist(), float), g["n"].to_numpy()
        mean = (x * n[:, None]).sum(0) / n.sum()
        sd = np.sqrt((((x - mean) ** 2) * n[:, None]).sum(0) / n.sum())
        z = np.where(sd > 0, (x - mean) / np.where(sd > 0, sd, 1), 0)
        return g.assign(topic=lloyd(z, n, int(g["cluster_num"].iloc[0]), seed=seed))[["__cid", "__key", "cluster_num", "topic"]]

    return written(each.groupBy("__cid", "cluster_num").applyInPandas(run, f"__cid {kind}, __key string, cluster_num int, topic int"), "clusters")


def clusterings(df: DataFrame, cid: str, vector: str, numbers: list[int], *, seed: int = 1) -> DataFrame:
    """df with columns cluster_num and topic: a row for each of numbers, with the row's cluster from 0 by k-means of its video's vectors in as many clusters.

    Components are z-scored over a video's rows before. Each video and number is a task that has the video's different
    vectors, with their counts, in memory. Rows without cid or vector have no clusters and no rows here. Rows meet their
    clusters by vector_key, so their vectors are shuffled only where the result's are read.
    """
    got = clusters_of_keys(df, cid, vector, numbers, seed=seed)
    rows = df.where(F.col(cid).isNotNull()).withColumn("__own", vector_key(F.col(vector))).where(F.col("__own").isNotNull())
    return rows.join(got.hint("merge"), (F.col(cid) == F.col("__cid")) & (F.col("__own") == F.col("__key"))).select(*df.columns, "cluster_num", "topic")


def nearest_centre(df: DataFrame, id_: str, vector: str, centres: list[tuple[int, list[float]]]) -> DataFrame:
    """(id, cluster, distance): the nearest of a few centres, the first of equal ones."""
    v = F.col(vector).cast("array<double>")
    square = lambda c: F.aggregate(F.zip_with(v, F.array(*map(F.lit, c)), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    best = F.array_min(F.array(*(F.struct(square(c).alias("d"), F.lit(i).alias("i")) for i, c in centres)))
    return df.select(id_, best.alias("b")).select(id_, F.col("b.i").alias("cluster"), F.sqrt("b.d").alias("distance"))


def pair_indices(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """One row (ss, sd, ds, dd, jaccard, fmi, rand) from the contingency table of clusters and labels, without any pairs."""
    pairs = lambda n: n * (n - 1) / 2
    cells = df.groupBy(cluster, label).agg(F.count(F.lit(1)).cast("double").alias("n"))
    both = cells.agg(F.sum(pairs(F.col("n"))).alias("ss"), F.sum("n").alias("n"))
    one = cells.groupBy(cluster).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("c"))
    other = cells.groupBy(label).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("l"))
    c, l = one.scalar(), other.scalar()
    out = both.select("ss", (c - F.col("ss")).alias("sd"), (l - F.col("ss")).alias("ds"), (pairs(F.col("n")) - c - l + F.col("ss")).alias("dd"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return out.select(
        "ss", "sd", "ds", "dd", ratio(F.col("ss"), F.col("ss") + F.col("sd") + F.col("ds")).alias("jaccard"),
        F.sqrt(ratio(F.col("ss"), F.col("ss") + F.col("sd")) * ratio(F.col("ss"), F.col("ss") + F.col("ds"))).alias("fmi"),
        ratio(F.col("ss") + F.col("dd"), F.col("ss") + F.col("sd") + F.col("ds") + F.col("dd")).alias("rand"),
    )


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), float)


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The distances of the rows of x from those of y, by differences: equal vectors are 0 apart."""
    return np.stack([np.sqrt(((r - y) ** 2).sum(1)) for r in x])


def nearest(queries: DataFrame, df: DataFrame, id_: str, vector: str, k: int, *, within: float = 0.0, query_block: int = 4096, row_block: int = 16384) -> DataFrame:
    """(a, b, distance, rank, near): the k nearest other rows of df for each query, ranked from 1, ties by id; near: on the first, how many others are nearer than within.

    queries has rows of df, such as each fiftieth for the density estimates below. Blocks of queries are held against
    blocks of rows; only the k nearest of each block and a count leave it, so no distances of all pairs are anywhere.
    Rows without id or vector don't count. A query without other rows has none here.
    """
    rows, asked = (x.where(F.col(id_).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")) for x in (df, queries))
    across, down = max(1, -(-rows.count() // row_block)), max(1, -(-asked.count() // query_block))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = asked.select(part(down).alias("p"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("q"), "id", "v")
    right = rows.select(F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("p2"), part(across).alias("q2"), F.col("id").alias("id2"), F.transform("v", lambda x: x).alias("v2"))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = {"a": [], "b": [], "distance": [], "count": []}
        if len(a) and len(b):
            ids, y = b["id2"].to_numpy(), _matrix(b["v2"])
            for query, x in zip(a["id"], a["v"], strict=True):
                d = np.sqrt(((np.array(x, float) - y) ** 2).sum(1))
                others = ids != query
                d, i = d[others], ids[others]
                order = np.lexsort((i, d))[:k]
                out["a"] += [query] * len(order)
                out["b"] += i[order].tolist()
                out["distance"] += d[order].tolist()
                out["count"] += ([int((d < within).sum())] + [0] * (len(order) - 1)) if len(order) else []
        return pd.DataFrame(out)

    found = left.groupBy("p", "q").cogroup(right.groupBy("p2", "q2")).applyInPandas(best, "a bigint, b bigint, distance double, count bigint")
    by = Window.partitionBy("a")
    ranked = found.withColumns({"rank": F.row_number().over(by.orderBy("distance", "b")), "__near": F.sum("count").over(by)})
    return ranked.where(F.col("rank") <= k).select("a", "b", "distance", "rank", F.when(F.col("rank") == 1, F.col("__near")).otherwise(0).alias("near"))


def fitted_eps(distances: DataFrame, distance: str) -> float:
    """A distance for clusters of density: where the quartic through the rising distances, each row's to its k-th nearest, turns.

    The fit is by least squares from sums of powers of each distance's place, scaled to -1 .. 1: one row for the driver.
    Fewer than five distances, or a quartic that doesn't turn, give the greatest.
    """
    placed = positions(distances.where(F.col(distance).isNotNull()).select(F.col(distance).alias("y")), [], ["y"], "at")
    n = placed.count()
    if not n:
        raise ValueError("no distances")
    t = F.col("at") * (2.0 / max(n - 1, 1)) - 1
    sums = placed.agg(*(F.sum(t**k).alias(f"t{k}") for k in range(9)), *(F.sum(F.col("y") * t**k).alias(f"y{k}") for k in range(5)), F.max("y").alias("greatest")).first()
    if n < 5:
        return sums.greatest
    _, _, c, b, a = np.linalg.solve([[sums[f"t{i + j}"] for j in range(5)] for i in range(5)], [sums[f"y{i}"] for i in range(5)])
    inner = 36 * b * b - 96 * a * c
    if inner < 0 or a == 0:
        return sums.greatest
    root = (-6 * b + np.sqrt(inner)) / (24 * a)
    place = min(max(int((root + 1) * (n - 1) / 2), 0), n - 1)
    return placed.where(F.col("at") == place).first().y


def grid_axes(df: DataFrame, id_: str, vector: str, n: int = 3, *, sample: int = 2000) -> np.ndarray:
    """n orthonormal directions in which the vectors are spread most, from at most sample rows, those of the lowest hashes. Any directions give a right grid."""
    rows = df.where(F.col(id_).isNotNull() & F.col(vector).isNotNull()).orderBy(F.xxhash64(id_)).limit(sample).select(F.col(vector).cast("array<double>").alias("v")).collect()
    if not rows:
        return np.ones((1, 1))
    some = _matrix(pd.Series([r.v for r in rows]))
    _, _, axes = np.linalg.svd(some - some.mean(0), full_matrices=True)
    return axes[: min(n, some.shape[1])]


def _cells(df: DataFrame, id_: str, vector: str, eps: float, *, block: int, axes: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(left, right) of blocks of rows, with the same key k, that hold every two rows at most eps apart at least once, a row with itself as well.

    The grid has cells of width eps in a few directions, so that such rows are in one cell or in neighbouring ones.
    Each two neighbouring cells are there once, in blocks of about block rows by a hash, so that a crowded cell is many
    tasks' work; same: the two blocks are one.
    """
    rows = df.where(F.col(id_).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_).alias("id"), F.col(vector).cast("array<double>").alias("v"), *(c for c in df.columns if c == "core"))
    along = lambda x: F.aggregate(F.zip_with("v", F.array(*map(F.lit, x.tolist())), lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y)
    # a cell is a little wider than eps, for what is lost in rounding
    rows = rows.withColumn("cell", F.array(*(F.floor(along(x) / (eps * (1 + 1e-9))) for x in axes)))
    cells = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    steps = [x for x in np.ndindex(*[3] * len(axes)) if x >= (1,) * len(axes)]  # each two neighbours once, and a cell itself
    to = F.explode(F.array(*(F.array(*(F.get("cell", F.lit(i)) + int(d) - 1 for i, d in enumerate(x))) for x in steps))).alias("other")
    both = cells.select("cell", "n", "blocks", to).join(cells.select(F.col("cell").alias("other"), F.col("n").alias("n2"), F.col("blocks").alias("blocks2")), "other")
    # for each cell and side the cells on the other side and their blocks, 27 at most in three dimensions
    sides = lambda own, far, n, blocks, far_blocks: both.groupBy(F.col(own).alias("own")).agg(F.max(n).alias("__n"), F.max(blocks).alias("__blocks"), F.collect_list(F.struct(F.col(far).alias("cell"), F.col(far_blocks).alias("blocks"))).alias("__far"))

    def placed(table: DataFrame) -> DataFrame:
        hot = join_by_frequency(rows, "cell", table.withColumnRenamed("own", "cell"), "__n", ["id"], how="inner")
        own = hot.withColumn("b", F.pmod(F.xxhash64("id"), F.col("__blocks")).cast("int"))
        return own.select("id", "v", *(c for c in rows.columns if c == "core"), "cell", "b", F.explode("__far").alias("f")).select("*", F.explode(F.sequence(F.lit(0), F.col("f.blocks") - 1)).alias("b2"))

    same = F.col("cell") == F.col("f.cell")
    left = placed(sides("cell", "other", "n", "blocks", "blocks2")).where(~same | (F.col("b") <= F.col("b2"))).select(F.struct("cell", "b", F.col("f.cell").alias("other"), "b2").alias("k"), "*")
    right = placed(sides("other", "cell", "n2", "blocks2", "blocks")).where(~same | (F.col("b2") <= F.col("b"))).select(F.struct(F.col("f.cell").alias("cell"), F.col("b2").alias("b"), F.col("cell").alias("other"), F.col("b").alias("b2")).alias("k"), "*")
    keep = [c for c in rows.columns if c == "core"]
    return left.select("k", (same & (F.col("b") == F.col("b2"))).alias("same"), "id", "v", *keep), right.select(F.col("k").alias("k2"), F.col("id").alias("id2"), F.transform("v", lambda x: x).alias("v2"), *(F.col(c).alias(f"{c}2") for c in keep))


def eps_counts(df: DataFrame, id_: str, vector: str, eps: float, *, block: int = 512, axes: np.ndarray | None = None) -> DataFrame:
    """(id, n): how many rows are at most eps from each, itself as well. Only counts leave a block; see _cells for the blocks. Rows without id or vector are left out."""
    left, right = _cells(df, id_, vector, eps, block=block, axes=grid_axes(df, id_, vector) if axes is None else axes)

    def count(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "n": []})
        near = _far(_matrix(a["v"]), _matrix(b["v2"])) <= eps
        out = [pd.DataFrame({"id": a["id"], "n": near.sum(1)})]
        if not a["same"].iloc[0]:
            out.append(pd.DataFrame({"id": b["id2"].to_numpy(), "n": near.sum(0)}))
        return pd.concat(out)

    kind = df.schema[id_].dataType.simpleString()
    got = left.groupBy("k").cogroup(right.groupBy("k2")).applyInPandas(count, f"id {kind}, n bigint")
    return got.groupBy("id").agg(F.sum("n").alias("n")).select(F.col("id").alias(id_), "n")


def _stars(near: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The connected parts of a matrix of links between its rows and columns: (rows, columns) of each."""
    free, seen, out = near.any(1), np.zeros(near.shape[1], bool), []
    while free.any():
        rows, columns = np.zeros(len(near), bool), np.zeros(near.shape[1], bool)
        edge = np.zeros(len(near), bool)
        edge[np.argmax(free)] = True
        while edge.any():
            rows |= edge
            new = near[edge].any(0) & ~columns
            columns |= new
            edge = near[:, new].any(1) & ~rows
        free &= ~rows
        seen |= columns
        out.append((np.flatnonzero(rows), np.flatnonzero(columns)))
    return out


def components(edges: DataFrame) -> DataFrame:
    """(id, c): for each id of the links (u, v) the lowest that it is connected with.

    Links are turned into stars around ever lower ids, by turns around the lowest neighbour of all and of the lower ones
    (alternating large and small stars), in about the logarithm of the longest path's rounds; a node with very many links is salted.
    Each round's links are a table, so lineage stays short.
    """
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        large = join_by_frequency(both.where("v > u"), "u", lowest, "n", ["v"], how="inner").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = written(large, "links")
        lower = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_by_frequency(large, "u", lower, "n", ["v"], how="inner").select("u", "v", "m")
        edges = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "links")
        new = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == state:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("c")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("c")).distinct())
        state = new


def dbscan(df: DataFrame, id_: str, vector: str, eps: float, least: float, *, block: int = 512, dimensions: int = 3) -> DataFrame:
    """(id, cluster): clusters of density, numbered from 0 by their lowest core; NOISE for none.

    A row with at least least rows within eps, itself counted, is a core. Cores within eps of each other are one
    cluster. Another row near cores belongs to the lowest-numbered of their clusters. Rows without id or vector are
    left out.

    Exact, in two passes over blocks of a grid: one counts neighbours, the other gives for two blocks the stars that
    connect what is connected in them, no more links than they have rows, and for each row that is no core one core of
    each such star near it. Where eps is as wide as the data, as in vectors of many dimensions, all rows are in
    neighbouring cells, and all blocks are held against all.
    """
    axes = grid_axes(df, id_, vector, dimensions)
    counts = eps_counts(df, id_, vector, eps, block=block, axes=axes)
    flagged = df.select(id_, vector).join(counts, id_).select(id_, vector, (F.col("n") >= least).alias("core"))
    left, right = _cells(written(flagged, "cores"), id_, vector, eps, block=block, axes=axes)
    kind = df.schema[id_].dataType.simpleString()

    def link(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"u": [], "v": [], "border": []})]
        if len(a) and len(b):
            near = _far(_matrix(a["v"]), _matrix(b["v2"])) <= eps
            x, y, core, core2 = a["id"].to_numpy(), b["id2"].to_numpy(), a["core"].to_numpy(bool), b["core2"].to_numpy(bool)
            links = near & core[:, None] & core2[None]
            top = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
            for k, (i, j) in enumerate(_stars(links), 1):
                ids = np.concatenate([x[i], y[j]])
                out.append(pd.DataFrame({"u": ids, "v": ids.min(), "border": False}))
                top[0][i], top[1][j] = k, k
            # rows that are no core: a core of each star near them; cores without a star here stand for themselves
            for rows, mine, others, own, stars in ((near, x, y, core2, top[1]), (near.T, y, x, core, top[0])):
                plain = ~(core if mine is x else core2)
                stars = np.where(stars > 0, stars, np.arange(len(stars)) + len(x) + len(y) + 1)
                i, j = np.nonzero(rows & plain[:, None] & own[None])
                _, first = np.unique(np.stack([i, stars[j]]), axis=1, return_index=True)
                out.append(pd.DataFrame({"u": mine[i[first]], "v": others[j[first]], "border": True}))
        return pd.concat(out).astype({"border": bool})

    links = written(left.groupBy("k").cogroup(right.groupBy("k2")).applyInPandas(link, f"u {kind}, v {kind}, border boolean"), "density")
    core = links.where("not border")
    joined = components(core.select("u", "v"))
    alone = core.select(F.col("u").alias("id")).distinct().join(joined, "id", "left_anti").select("id", F.col("id").alias("c"))
    label = written(joined.unionByName(alone), "labels")
    numbers = positions(label.select("c").distinct(), [], ["c"], "cluster")
    sizes = label.groupBy("c").agg(F.count(F.lit(1)).alias("n")).join(numbers, "c")
    labelled = join_by_frequency(label, "c", sizes, "n", ["id"], how="inner").select("id", "cluster")
    border = links.where("border").select(F.col("u").alias("id"), "v").join(labelled.withColumnRenamed("id", "v"), "v").groupBy("id").agg(F.min("cluster").alias("border"))
    rows = counts.select(F.col(id_).alias("id"))
    return rows.join(labelled, "id", "left").join(border, "id", "left").select(F.col("id").alias(id_), F.coalesce("cluster", "border", F.lit(NOISE)).cast("int").alias("cluster"))


def members(labelled: DataFrame, id_: str) -> DataFrame:
    """(cluster, members, id): a row for each member of each cluster, with how many it has; noise is the cluster NOISE."""
    sizes = labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    return join_by_frequency(labelled, "cluster", sizes, "members", [id_], how="inner").select("cluster", "members", id_)
