"""Unsupervised feature selection: lagged correlation, clusters, importance, groups."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.operators import panel, reconstruct, spread, windows

# Features per side of one block of pairwise aggregates.
TILE = 8


def _pair_sums(pairs: DataFrame, keys: Sequence[str], features: Sequence[str], counted: bool = False) -> DataFrame:
    """Sums over the rows of array columns a and b for every ordered feature pair, in one pass.

    (keys, feature_i, feature_j, dot = sum a_i b_j, aa = sum a_i^2, bb = sum b_j^2, and n when
    ``counted``). Rows are repeated once per tile of TILE x TILE pairs, not once per pair; only
    the sums of a tile are shuffled.
    """
    features = list(features)
    starts = range(0, len(features), TILE)
    tiles = [
        F.struct(
            F.lit(i).alias("i"),
            F.lit(j).alias("j"),
            F.slice("a", i + 1, TILE).alias("a"),
            F.slice("b", j + 1, TILE).alias("b"),
        )
        for i in starts
        for j in starts
    ]
    side = range(min(TILE, len(features)))
    cut = pairs.select(*keys, F.inline(F.array(*tiles)))
    cut = cut.select(
        *keys,
        "i",
        "j",
        *[F.get(F.col("a"), F.lit(i)).alias(f"a{i}") for i in side],
        *[F.get(F.col("b"), F.lit(j)).alias(f"b{j}") for j in side],
    )
    dots = {(i, j): F.col(f"a{i}") * F.col(f"b{j}") for i in side for j in side}
    wide = cut.groupBy(*keys, "i", "j").agg(
        *[F.sum(x).alias(f"dot_{i}_{j}") for (i, j), x in dots.items()],
        *[F.sum(F.col(f"a{i}") * F.col(f"a{i}")).alias(f"aa_{i}") for i in side],
        *[F.sum(F.col(f"b{j}") * F.col(f"b{j}")).alias(f"bb_{j}") for j in side],
        *([F.count(x).alias(f"n_{i}_{j}") for (i, j), x in dots.items()] if counted else []),
    )
    names = F.array(*[F.lit(f) for f in features])
    rows = [
        F.struct(
            F.get(names, F.col("i") + i).alias("feature_i"),
            F.get(names, F.col("j") + j).alias("feature_j"),
            F.col(f"dot_{i}_{j}").alias("dot"),
            F.col(f"aa_{i}").alias("aa"),
            F.col(f"bb_{j}").alias("bb"),
            *([F.col(f"n_{i}_{j}").alias("n")] if counted else []),
        )
        for i, j in dots
    ]
    return wide.select(*keys, F.inline(F.array(*rows))).where("feature_i IS NOT NULL AND feature_j IS NOT NULL")


def _ahead(df: DataFrame, by: Sequence[str], columns: Sequence[str], lags: int, size: int | None) -> DataFrame:
    """Rows with arrays of the current and the next ``lags`` rows, as ``_near``."""
    frame = lambda w: {
        "_near": F.collect_list(F.struct("t", *columns)).over(w.rowsBetween(0, lags))
    }
    return spread.windowed(df, by, 0, lags, build=frame, size=size)


def lagged_products(
    df: DataFrame, by: Sequence[str], features: Sequence[str], tau: int, size: int | None = None
) -> DataFrame:
    """(by, feature_i, feature_j, n, dot): products of feature_i at t with feature_j at t + tau."""
    near = _ahead(panel.to_array(df, [*by, "t"], features), by, ["values"], tau, size)
    pairs = near.where(F.size("_near") == tau + 1).select(
        *by, F.col("values").alias("a"), F.col("_near")[tau]["values"].alias("b")
    )
    sums = _pair_sums(pairs, by, features, counted=True)
    return sums.select(*by, "feature_i", "feature_j", "n", "dot")


def lagged_spearman(
    df: DataFrame,
    by: Sequence[str],
    features: Sequence[str],
    max_lag: int,
    decay: float | None = None,
    size: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """(by, feature_i, feature_j, sim): greatest |rank correlation| of differences over lags.

    The values are ranked once over the whole series. A lag drops at most ``max_lag`` rows at
    one end, so the rank within the remaining rows follows from the full rank and the few
    dropped values. Blocks of one bucket each then add up their products in numpy, and the
    sums of the blocks are added by Spark. ``features`` must hold no nulls.
    """
    by = list(by)
    steps = windows.diff(df.select(*by, "t", *features), by, features, size=size).withColumn("t", F.col("t") - 1)
    steps = spread.durable(steps)
    long = panel.to_long(steps, [*by, "t"], features)
    per_feature = steps.select(*by, F.lit("any").alias("feature"))
    ranked = windows.average_rank(long, [*by, "feature"], "x", "r", limit, per_feature)

    sizes = steps.groupBy(*by).agg((F.max("t") + 1).alias("n"))
    ends = spread.lookup_join(steps, sizes, by)
    row = F.array(*features)
    head = F.when(F.col("t") < max_lag, F.struct("t", row.alias("v")))
    tail = F.when(F.col("t") >= F.col("n") - max_lag, F.struct((-F.col("t")).alias("t"), row.alias("v")))
    ends = ends.groupBy(*by).agg(
        F.max("n").alias("n"),
        F.transform(F.array_sort(F.collect_list(head)), lambda s: s["v"]).alias("head"),
        F.transform(F.array_sort(F.collect_list(tail)), lambda s: s["v"]).alias("tail"),
    )

    wide = ranked.groupBy(*by, "t").agg(
        *[F.max(F.when(F.col("feature") == f, F.col(c))).alias(f"{c}_{f}") for f in features for c in ("x", "r")]
    )
    rows = wide.select(
        *by,
        "t",
        F.array(*[F.col(f"x_{f}") for f in features]).alias("x"),
        F.array(*[F.col(f"r_{f}") for f in features]).alias("r"),
    )
    size = size or spread.BUCKET
    blocks = spread.with_halo(rows, 0, max_lag, size=size).drop("_home")
    last = F.floor((F.col("n") - 1) / F.lit(size))
    context = spread.durable(ends).withColumn("_bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    keys = [*by, "_bucket"]
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in by)
    sums = (
        blocks.groupBy(*keys)
        .cogroup(context.groupBy(*keys))
        .applyInArrow(
            _lagged_sums(by, len(features), max_lag, size),
            f"{types}, tau int, dot array<double>, aa array<double>, bb array<double>",
        )
    )
    width = len(features)
    names = F.array(*[F.lit(f) for f in features])
    cells = sums.select(*by, "tau", "aa", "bb", F.posexplode("dot").alias("_at", "dot")).select(
        *by,
        "tau",
        "dot",
        F.floor(F.col("_at") / width).cast("int").alias("i"),
        (F.col("_at") % width).alias("j"),
        "aa",
        "bb",
    )
    rho = (
        cells.where("i <> j")
        .groupBy(*by, "tau", "i", "j")
        .agg(
            F.sum("dot").alias("dot"),
            F.sum(F.get("aa", F.col("i"))).alias("aa"),
            F.sum(F.get("bb", F.col("j"))).alias("bb"),
        )
    )
    varied = (F.col("aa") > 0) & (F.col("bb") > 0)
    strength = F.when(varied, F.abs(F.col("dot")) / F.sqrt(F.col("aa") * F.col("bb"))).otherwise(0.0)
    if decay:
        strength = strength * F.exp(-F.col("tau") / F.lit(float(decay)))
    ways = [
        F.struct(F.get(names, F.col(i)).alias("feature_i"), F.get(names, F.col(j)).alias("feature_j"), strength.alias("_s"))
        for i, j in (("i", "j"), ("j", "i"))
    ]
    both = rho.select(*by, F.inline(F.array(*ways)))
    return both.groupBy(*by, "feature_i", "feature_j").agg(F.max("_s").alias("sim"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column (or of one list of lists) as a matrix."""
    flat = column.combine_chunks()
    while pa.types.is_list(flat.type):
        flat = flat.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width)


def _lagged_sums(by: Sequence[str], width: int, max_lag: int, size: int):
    """Per block of one series: products of centred ranks at t and t + tau, summed for every lag."""

    def sums(key: tuple, block: pa.Table, ends: pa.Table) -> pa.Table:
        taus, dots, aas, bbs = [], [], [], []
        if len(block) and len(ends):
            t = block["t"].to_numpy()
            order = np.argsort(t)
            t, x, r = t[order], _matrix(block["x"], width)[order], _matrix(block["r"], width)[order]
            n = ends["n"][0].as_py()
            head, tail = _matrix(ends["head"], width), _matrix(ends["tail"], width)
            own = int((t // size == key[-1].as_py()).sum())
            ahead, behind = np.zeros_like(r), np.zeros_like(r)
            for tau in range(min(max_lag, n // 2) + 1):
                if tau:
                    ahead += (tail[tau - 1] < x) + 0.5 * (tail[tau - 1] == x)
                    behind += (head[tau - 1] < x) + 0.5 * (head[tau - 1] == x)
                m = min(own, len(t) - tau)
                if m <= 0:
                    break
                middle = (n - tau + 1) / 2
                a = (r - ahead - middle)[:m]
                b = (r - behind - middle)[tau : tau + m]
                taus.append(tau)
                dots.append((a.T @ b).ravel())
                aas.append((a * a).sum(axis=0))
                bbs.append((b * b).sum(axis=0))
        lists = pa.list_(pa.float64())
        columns = {c: pa.array([k.as_py()] * len(taus), k.type) for c, k in zip(by, key)}
        columns |= {"tau": pa.array(taus, pa.int32())}
        columns |= {c: pa.array(v, lists) for c, v in (("dot", dots), ("aa", aas), ("bb", bbs))}
        return pa.table(columns)

    return sums


def _average_linkage(dist: np.ndarray, cut: float) -> np.ndarray:
    """Cluster numbers (from 1, by first member) of average linkage cut at a distance."""
    n = len(dist)
    return linked_clusters(np.asarray(dist, float)[np.triu_indices(n, 1)], n, cut)


def linked_clusters(pairs: np.ndarray, n: int, cut: float) -> np.ndarray:
    """The same from the distances of the pairs (0, 1), (0, 2) ... in one array, which is used up.

    Chains of nearest neighbours end in two clusters that are each other's nearest; average linkage may merge
    these at once, in any order, so that all merges take n^2 steps. A cluster whose nearest neighbour is beyond the cut
    never merges again and is left out.
    """
    start = np.array([i * (2 * n - i - 1) // 2 - i - 1 for i in range(n)], np.int64)
    here, weight, parent = np.ones(n, bool), np.ones(n), list(range(n))
    ids = np.arange(n)

    def places(i: int) -> np.ndarray:
        """Where the distances of i to all others stand (its own place is of no use)."""
        return np.where(ids < i, start + i, start[i] + ids)

    chain: list[int] = []
    while here.any():
        if not chain:
            chain.append(int(np.argmax(here)))
        i = chain[-1]
        others = here.copy()
        others[i] = False
        if not others.any():
            break
        on = ids[others]
        row = pairs[places(i)[on]]
        best = row.min()
        if not best <= cut:
            here[i] = False
            chain.pop()
            continue
        # Of equally near clusters the one that the chain came from, else it might not end.
        j = chain[-2] if len(chain) > 1 and pairs[places(i)[chain[-2]]] == best else int(on[np.argmin(row)])
        if len(chain) < 2 or j != chain[-2]:
            chain.append(j)
            continue
        del chain[-2:]
        i, j = min(i, j), max(i, j)
        rest = on[(on != i) & (on != j)]
        mine, other = places(i)[rest], places(j)[rest]
        pairs[mine] = (weight[i] * pairs[mine] + weight[j] * pairs[other]) / (weight[i] + weight[j])
        weight[i] += weight[j]
        here[j], parent[j] = False, i

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    return pd.factorize(np.array([root(i) for i in range(n)], np.int64))[0] + 1


def cluster_redundant(
    sim: DataFrame, by: Sequence[str], features: Sequence[str], corr_threshold: float = 0.9
) -> DataFrame:
    """(by, feature, cluster, medoid): features whose similarity joins them above the threshold.

    Every series has all of the features; see ``cluster_members`` for series with features of their own.
    """
    by, features = list(by), list(features)
    sim = spread.durable(sim)
    names = F.explode(F.array(*[F.lit(f) for f in features]))
    members = sim.select(*by).distinct().select(*by, names.alias("feature"))
    return cluster_members(members.withColumn("corr_threshold", F.lit(float(corr_threshold))), sim, by, features)


def cluster_members(members: DataFrame, sim: DataFrame, by: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(by, feature, cluster, medoid) of the features that each series has.

    ``members`` has (by, feature, corr_threshold): a series' own features and its threshold. Pairs without a
    similarity have none, and a lone feature is a cluster of one. A task gets the distances of the
    pairs of its series one series after the other, never their rows.
    """
    by, features = list(by), list(features)
    members, sim = spread.durable(members), spread.durable(sim)
    return medoids(spread.durable(linked_members(members, sim, by, features)), sim, by, features)


def linked_members(members: DataFrame, sim: DataFrame, by: list[str], features: list[str]) -> DataFrame:
    """(by, feature, cluster) by average linkage, all series of a task in one call.

    Rows of a series come sorted: its features (i, -1, threshold), then its pairs (i, j, similarity).
    """
    names = F.array(*[F.lit(f) for f in features])

    def place(c: str):
        return (F.array_position(names, F.col(c)) - 1).cast("int")

    own = members.select(*by, place("feature").alias("i"), F.lit(-1).alias("j"), F.col("corr_threshold").cast("double").alias("x"))
    pairs = sim.select(*by, place("feature_i").alias("i"), place("feature_j").alias("j"), F.col("sim").cast("double").alias("x"))
    rows = own.unionByName(pairs.where("i >= 0 AND i < j"))
    rows = rows.repartition(*by) if by else rows.coalesce(1)
    rows = rows.sortWithinPartitions(*by, "j", "i")
    width = len(by)

    def clusters(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
        i, j, x = (np.concatenate(c) for c in zip(*held, strict=True))
        on = j < 0
        mine = np.unique(i[on])
        n = len(mine)
        if not n:
            return mine, mine
        if mine[0] < 0:
            raise ValueError("a series has a feature that is not among the features")
        cut, at = 1.0 - x[on][0], np.full(len(features), -1)
        at[mine] = np.arange(n)
        i, j, x = at[i[~on]], at[j[~on]], x[~on]
        both = (i >= 0) & (j >= 0)
        i, j, x = i[both], j[both], x[both]
        dist = np.ones(n * (n - 1) // 2)
        dist[i * (2 * n - i - 1) // 2 + j - i - 1] = np.clip(1.0 - x, 0.0, 1.0)
        return mine, linked_clusters(dist, n, cut)

    def same(a: tuple, b: tuple) -> bool:
        return a == b or all(p == q or (p != p and q != q) for p, q in zip(a, b, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, kinds = None, [], []
        done: list[tuple] = []

        def close() -> None:
            if held:
                done.append((last, *clusters(held)))
                held.clear()

        def flush() -> pa.RecordBatch:
            many = [len(m) for _, m, _ in done]
            keys = [pa.array([k[c] for (k, _, _), n in zip(done, many, strict=True) for _ in range(n)], kinds[c]) for c in range(width)]
            out = [
                pa.array([features[p] for _, m, _ in done for p in m.tolist()], pa.string()),
                pa.array([int(c) for _, _, cs in done for c in cs], pa.int32()),
            ]
            done.clear()
            return pa.RecordBatch.from_arrays([*keys, *out], [*by, "feature", "cluster"])

        for batch in batches:
            kinds = [batch.column(c).type for c in range(width)]
            keys = list(zip(*[batch.column(c).to_pylist() for c in range(width)], strict=True)) if by else [()] * batch.num_rows
            i, j, x = (batch.column(width + c).to_numpy(zero_copy_only=False) for c in range(3))
            at = 0
            while at < len(keys):
                upto = at + 1
                while upto < len(keys) and same(keys[upto], keys[at]):
                    upto += 1
                if not held or not same(keys[at], last):
                    close()
                    last = keys[at]
                held.append((i[at:upto], j[at:upto], x[at:upto]))
                at = upto
            yield flush()
        close()
        if done:
            yield flush()

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for c in by for f in sim.schema if f.name == c)
    return rows.mapInArrow(run, ", ".join(x for x in (types, "feature string, cluster int") if x))


def medoids(members: DataFrame, sim: DataFrame, by: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Add the medoid of each cluster: least total distance, the earlier feature on ties."""
    by = list(by)
    order = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature"))
    left = members.withColumnRenamed("feature", "feature_i")
    right = members.select(*by, F.col("feature").alias("feature_j"), "cluster")
    near = spread.join_null_safe(sim, left, [*by, "feature_i"], many=True)
    near = spread.join_null_safe(near, right, [*by, "feature_j", "cluster"], many=True)
    spent = near.groupBy(*by, F.col("feature_i").alias("feature")).agg(
        F.sum(F.least(F.greatest(1 - F.col("sim"), F.lit(0.0)), F.lit(1.0))).alias("_d")
    )
    totals = spread.join_null_safe(members, spent, [*by, "feature"], "left", many=True)
    best = totals.groupBy(*by, "cluster").agg(
        F.min_by("feature", F.struct(F.round(F.coalesce("_d", F.lit(0.0)), 12), order)).alias("medoid")
    )
    found = spread.join_null_safe(members, best, [*by, "cluster"], many=True)
    return found.select(*by, "feature", "cluster", "medoid")


def cluster_importance(clusters: DataFrame, importance: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, cluster, medoid, importance) from the importance of each medoid."""
    by = list(by)
    reps = clusters.select(*by, "cluster", "medoid").distinct()
    return spread.join_null_safe(reps, importance.withColumnRenamed("feature", "medoid"), [*by, "medoid"], many=True)


# ---- importance -----------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit values from 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def block_order(draws: np.ndarray, length: int, feature: int, repeat: int) -> np.ndarray:
    """Positions of each window after its contiguous blocks are put in hashed order."""
    n_blocks = max(1, length // max(1, length // 4))
    block = np.repeat(np.arange(n_blocks), [len(p) for p in np.array_split(np.arange(length), n_blocks)])
    salt = np.uint64(1 + feature * 1009 + repeat)
    keys = _mixed(draws.astype(np.uint64)[:, None] + salt * np.arange(1, n_blocks + 1, dtype=np.uint64)[None, :])
    return np.argsort(keys[:, block], axis=1, kind="stable")


def mask_importance(
    wins: DataFrame,
    by: Sequence[str],
    features: Sequence[str],
    length: int,
    model: "reconstruct.WindowPca",
    repeats: int = 3,
    seed: int = 42,
) -> DataFrame:
    """(by, feature, importance): rise of the reconstruction error when one feature is shuffled in blocks.

    The model is linear, so a change of a feature's columns moves the reconstruction by (change R) B', R being the basis
    rows of these columns, and the error rises by 2 (change R) (B' error) + (change R) (B'B) (change R)': k numbers a
    window instead of a whole reconstruction. Every batch of windows adds up its own sums; only they are
    shuffled. The order of the blocks depends on the window and the seed alone.
    """
    by, features = list(by), list(features)
    mean, basis, width = model.mean, model.basis, len(features)
    gram = basis.T @ basis

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["vec"].to_numpy())
            draws = pdf["_draw"].to_numpy()
            z = (x - mean) @ basis
            # The error of the unchanged window along the basis: 0 where the basis is orthonormal.
            along = z @ gram - z
            cube = x.reshape(len(x), length, width)
            parts = []
            for fi, f in enumerate(features):
                rows, track, rise = basis[fi::width], cube[:, :, fi], np.zeros(len(x))
                for r in range(repeats):
                    moved = (np.take_along_axis(track, block_order(draws, length, fi, r), axis=1) - track) @ rows
                    rise += 2 * (moved * along).sum(axis=1) + ((moved @ gram) * moved).sum(axis=1)
                parts.append(pdf[by].assign(feature=f, rise=rise, n=repeats * x.shape[1]))
            out = pd.concat(parts).groupby([*by, "feature"], dropna=False, as_index=False).sum()
            yield out[[*by, "feature", "rise", "n"]]

    schema = wins.select(*by).schema.simpleString()[len("struct<") : -1].replace(":", " ")
    drawn = wins.select(*by, "vec", F.xxhash64(*by, "w", F.lit(seed)).alias("_draw"))
    rises = drawn.mapInPandas(sums, f"{schema}, feature string, rise double, n bigint")
    return rises.groupBy(*by, "feature").agg((F.sum("rise") / F.sum("n")).alias("importance"))


def forest_importance(
    wins: DataFrame, features: Sequence[str], y: str = "y", trees: int = 100, seed: int = 42
) -> DataFrame:
    """(feature, importance): random-forest importance of flattened windows, averaged over steps.

    Uses the labels of the windows it is given (the test set in the usual recipe).
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    data = wins.select(array_to_vector("vec").alias("features"), F.col(y).cast("double").alias("label"))
    fitted = RandomForestClassifier(numTrees=trees, seed=seed, maxDepth=5).fit(data)
    values = fitted.featureImportances.toArray().reshape(-1, len(features)).mean(axis=0)
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return wins.sparkSession.createDataFrame(rows, "feature string, importance double")


# ---- groups ---------------------------------------------------------------------------


def adaptive_thresholds(flags: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, corr_threshold, importance_percentile): stricter when most features are binary."""
    most = F.avg(F.col("is_binary").cast("int")) > 0.5
    return flags.groupBy(*by).agg(
        F.when(most, 0.95).otherwise(0.9).alias("corr_threshold"),
        F.when(most, 90).otherwise(50).alias("importance_percentile"),
    )


def _with_sentinels(groups: DataFrame, sentinel: DataFrame | None, by: Sequence[str]) -> DataFrame:
    if sentinel is None:
        return groups
    last = groups.groupBy(*by).agg((F.max("grp") + 1).alias("_next"))
    extra = spread.join_null_safe(sentinel.select(*by, "feature"), last, list(by), "left", many=True)
    extra = extra.select(
        *by, "feature", F.coalesce("_next", F.lit(0)).cast("int").alias("grp"), F.lit("sentinel").alias("kind")
    )
    return groups.unionByName(extra)


def _above_own(importance: DataFrame, percentiles: DataFrame, by: list[str]) -> DataFrame:
    """Marks as ``_high`` what is at or above its series' own percentile; the clusters of a series are few."""
    ordered = importance.groupBy(*by).agg(F.array_sort(F.collect_list("importance")).alias("_all"))
    ordered = spread.join_null_safe(ordered, percentiles.select(*by, "importance_percentile"), by, many=True)
    at = (F.size("_all") - 1) * F.col("importance_percentile") / 100
    lo, hi = (F.get("_all", f(at).cast("int")) for f in (F.floor, F.ceil))
    # As numpy's percentile does it.
    cuts = ordered.select(*by, (lo + (hi - lo) * (at - F.floor(at))).alias("_cut"))
    return spread.lookup_join(importance, cuts, by).withColumn("_high", F.col("importance") >= F.col("_cut"))


def assign_groups(
    members: DataFrame,
    importance: DataFrame,
    by: Sequence[str],
    percentile: float | DataFrame = 50.0,
    sentinel: DataFrame | None = None,
) -> DataFrame:
    """(by, feature, grp, kind): important clusters one by one, then the rest, then the sentinels.

    ``importance`` has one row per (by, cluster); clusters at or above the percentile of their
    series are important and numbered by falling importance. ``percentile`` is one number or a
    table (by, importance_percentile).
    """
    by = list(by)
    if isinstance(percentile, DataFrame):
        judged = _above_own(importance.select(*by, "cluster", "importance"), percentile, by)
    else:
        cut = spread.percentiles(importance, by, "importance", [percentile / 100])
        judged = spread.lookup_join(importance.select(*by, "cluster", "importance"), cut, by).withColumn(
            "_high", F.col("importance") >= F.col("q")[0]
        )
    order = Window.partitionBy(*by, "_high").orderBy(F.desc("importance"), "cluster")
    whole = Window.partitionBy(*by)
    judged = judged.withColumns(
        {"_place": F.row_number().over(order) - 1, "_n_high": F.count_if("_high").over(whole)}
    )
    placed = judged.select(
        *by,
        "cluster",
        F.when(F.col("_high"), F.col("_place")).otherwise(F.col("_n_high")).cast("int").alias("grp"),
        F.when(F.col("_high"), "important").otherwise("catch_all").alias("kind"),
    )
    groups = spread.join_null_safe(members, placed, [*by, "cluster"], many=True).select(*by, "feature", "grp", "kind")
    return _with_sentinels(groups, sentinel, by)


def group_modes(
    members: DataFrame,
    importance: DataFrame | None,
    by: Sequence[str],
    mode: str = "auto",
    percentile: float = 50.0,
    sentinel: DataFrame | None = None,
) -> DataFrame:
    """Feature groups by mode: auto (by importance), single (one group), clusters (one per cluster)."""
    if mode == "auto":
        return assign_groups(members, importance, by, percentile, sentinel)
    if mode == "single":
        groups = members.select(*by, "feature", F.lit(0).alias("grp"), F.lit("important").alias("kind"))
    elif mode == "clusters":
        dense = Window.partitionBy(*by).orderBy("cluster")
        groups = members.select(
            *by, "feature", (F.dense_rank().over(dense) - 1).alias("grp"), F.lit("important").alias("kind")
        )
    else:
        raise ValueError(f"unknown grouping mode {mode!r}")
    return _with_sentinels(groups, sentinel, by)


def top_features(importance: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """Add rank and part: ``top`` for the k most important features of a series, else ``rest``."""
    order = Window.partitionBy(*by).orderBy(F.desc("importance"), "feature")
    ranked = importance.withColumn("rank", F.row_number().over(order))
    return ranked.withColumn("part", F.when(F.col("rank") <= k, "top").otherwise("rest"))


def sorted_importance(importance: DataFrame, by: Sequence[str]) -> DataFrame:
    return importance.orderBy(*by, F.desc("importance"), "feature")


def union_groups(*parts: DataFrame) -> DataFrame:
    """All group rows, each (series, group, feature) once."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def shared_features(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def check_partition(groups: DataFrame, expected: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, feature, problem): overlap, missing or extra features; empty when the groups partition them."""
    keys = [*by, "feature"]
    overlap = groups.groupBy(*keys).agg(F.countDistinct("grp").alias("_n")).where("_n > 1")
    have, want = groups.select(*keys).distinct(), expected.select(*keys).distinct()
    return (
        overlap.select(*keys, F.lit("overlap").alias("problem"))
        .unionByName(want.exceptAll(have).withColumn("problem", F.lit("missing")))
        .unionByName(have.exceptAll(want).withColumn("problem", F.lit("extra")))
    )


def sorted_positions(groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, feature, position): dense position of each grouped feature in sorted order."""
    order = Window.partitionBy(*by).orderBy("feature")
    return groups.select(*by, "feature").distinct().withColumn("position", F.row_number().over(order) - 1)
