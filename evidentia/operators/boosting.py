"""Boosted trees for all bags of all variants at once.

Features are cut into few bins, missing values in a bin of their own below all others. A tree grows level by level:
the rows of a bag add up gradient, curvature and count per (model, node, feature, bin), and each
node takes the bin with the largest gain. Rows meet in blocks of bounded size: several small bags share a block
and grow there from the first tree to the last; a bag with more rows than a block is dealt over
several, whose sums are added by Spark after each level. Both ways run the same steps on the
same numbers, so the trees do not depend on the block size.

Row and column samples of a tree come from integer hashes of (seed, tree, model, row or
column), so they do not depend on how rows are spread either.

A fitted forest is data: flat node arrays whose size follows from the settings, never from the
number of rows. Scoring walks whole batches down all trees of a model level by level.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators.bagging import Plan, averaged
from evidentia.operators.ordering import quantiles
from evidentia.session import checkpoint_root

BLOCK = 1 << 21  # (row, model) pairs that one task holds, about 100 bytes and a byte per feature each
SHARE = 1 << 16  # pairs of a block that small bags share, and of one part of a divided bag
SHARED = 32  # small bags of one block
STRIDE = 1 << 15  # pairs added up at once
CUT = 1 << 12  # rows packed at once
REWRITE = 8  # trees between two versions of a divided bag's margins
LEAST_CURVE = 1e-3  # curvature either side of a split must have
U = np.uint64


@dataclass(frozen=True)
class TreeSettings:
    """Defaults of the published tree runs, with depth in place of a leaf count."""

    n_trees: int = 200
    max_depth: int = 5
    step: float = 0.05
    subsample: float = 0.8
    columns: float = 0.8
    min_rows: int = 50
    n_bins: int = 64  # at most 255
    seed: int = 1234

    @property
    def nodes(self) -> int:
        return 2 ** (self.max_depth + 1) - 1


@dataclass
class Forest:
    """Trees of every model of one variant; node ``i`` has the children ``2i + 1`` and ``2i + 2``.

    ``feature`` is -1 at a leaf. Rows go left if their bin is at most ``split``. ``cover`` counts the rows that
    grew the node.
    """

    features: list[str]
    plan: Plan
    edges: list[np.ndarray]
    feature: np.ndarray  # models x trees x nodes
    split: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    def thresholds(self) -> np.ndarray:
        """Values that rows of a split's left side do not exceed; below all where only missing ones go left."""
        low = np.array([np.concatenate([[-np.inf], e, np.full(256 - len(e), np.inf)]) for e in self.edges])
        return np.where(self.feature < 0, np.nan, low[np.maximum(self.feature, 0), self.split])


def binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bin of every value: 0 for missing, then one more for each edge it exceeds."""
    out = np.zeros(x.shape, dtype=np.uint8)
    for j, e in enumerate(edges):
        known = ~np.isnan(x[:, j])
        out[known, j] = 1 + np.searchsorted(e, x[known, j], side="left")
    return out


def bin_edges(train: DataFrame, features: Mapping[int, list[str]], n_bins: int) -> dict[int, list[np.ndarray]]:
    """Upper edges of the bins of every (variant, feature): distinct exact quantiles of the training rows.

    A value that is one of few gets a bin of its own. ``n_bins`` numbers a feature reach the driver.
    """
    inner = n_bins - 2  # besides the bin of missing values and the last one
    long = train.select("variant", F.posexplode("x").alias("at", "v")).where("NOT isnan(v)")
    probs = {f"q{i}": (i + 1) / (inner + 1) for i in range(inner)}
    rows = quantiles(long, "v", probs, ["variant", "at"]).collect()
    out = {v: [np.zeros(0)] * len(f) for v, f in features.items()}
    for r in rows:
        out[r["variant"]][r["at"]] = np.unique([r[q] for q in probs])
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _keys(settings: TreeSettings, tree: int, models: np.ndarray, what: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        base = U(settings.seed) * U(0x9E3779B97F4A7C15) + U(tree) * U(0xD1B54A32D192ED03) + U(what)
        return _mixed(base + models.astype(U) * U(0x8CB92BA72F3D8DD7))


def chosen_columns(settings: TreeSettings, tree: int, models: np.ndarray, n_features: int) -> np.ndarray:
    """Models x features: the columns a tree may split on."""
    wanted = max(1, math.ceil(settings.columns * n_features - 1e-9))
    if wanted >= n_features:
        return np.ones((len(models), n_features), dtype=bool)
    with np.errstate(over="ignore"):
        keys = _mixed(_keys(settings, tree, models, 1)[:, None] + np.arange(n_features, dtype=U) * U(0x9E3779B97F4A7C15))
    out = np.zeros((len(models), n_features), dtype=bool)
    np.put_along_axis(out, np.argsort(keys, axis=1, kind="stable")[:, :wanted], True, axis=1)
    return out


class Block:
    """Rows of one or more bags, or part of one bag, and how far their trees have come.

    An entry is one row of one bag: its bins (features x entries), number among ``models``, label, hash and weight.
    """

    def __init__(self, settings: TreeSettings, models: np.ndarray, bins: np.ndarray, model: np.ndarray, y: np.ndarray, hashes: np.ndarray,
                 weight: np.ndarray, margin: np.ndarray | None = None):
        self.settings, self.models, self.bins, self.model = settings, models, bins, model
        self.y, self.hash, self.weight = y, hashes, weight
        self.margin = np.zeros(len(y)) if margin is None else margin
        counts = [np.bincount(b, minlength=1) for b in bins]
        self.common = [int(c.argmax()) if 2 * c.max() > len(y) else -1 for c in counts]

    def start(self, tree: int) -> None:
        """Gradients and sampled rows of the next tree; all rows are at its root."""
        p = 1.0 / (1.0 + np.exp(-self.margin))
        gradient, curve = self.weight * (p - self.y), self.weight * p * (1.0 - p)
        self.node = np.zeros(len(self.y), dtype=np.int64)
        self.allowed = chosen_columns(self.settings, tree, self.models, len(self.bins))
        if self.settings.subsample < 1.0:
            keys = _mixed(self.hash ^ _keys(self.settings, tree, self.models, 0)[self.model])
            self.drawn = np.flatnonzero(keys < U(int(self.settings.subsample * 2.0**64)))
        else:
            self.drawn = np.arange(len(self.y))
        # What the levels add up, once per tree in one piece.
        self.measures = np.stack([m[self.drawn] for m in (gradient, curve, self.weight)])
        self.drawn_model = self.model[self.drawn]
        self.strides = [slice(s, s + STRIDE) for s in range(0, len(self.drawn), STRIDE)]
        self.listed = [[self._listed(j, self.drawn[part]) for j in self.columns()] for part in self.strides]

    def columns(self) -> np.ndarray:
        """Features that some model may use in this tree."""
        return np.flatnonzero(self.allowed.any(axis=0))

    def _listed(self, j: int, entries: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
        """Entries with other than the feature's commonest bin (none: all) and their bins."""
        bins = self.bins[j, entries]
        if self.common[j] < 0:
            return None, bins
        at = np.flatnonzero(bins != self.common[j])
        return at, bins[at]

    def sums(self, level: int) -> np.ndarray:
        """Models x nodes of a level x (gradient, curvature, count) x features x bins; 0 for a feature that no model may use.

        Rows are taken in strides that stay in the processor's cache while all features pass over them. A feature that
        mostly has one bin is added up over the other rows; that bin gets what is left of its node.
        """
        first, nodes, n_bins = 2**level - 1, 2**level, self.settings.n_bins
        n_models, n_features = len(self.models), len(self.bins)
        places = n_models * nodes
        size = places * n_bins
        out = np.zeros((3, n_features, size + n_bins))  # behind all nodes: rows that stay in a leaf further up
        whole = np.zeros((3, places + 1))
        for part, listed in zip(self.strides, self.listed):
            node, measures = self.node[self.drawn[part]], self.measures[:, part]
            place = np.where(node >= first, self.drawn_model[part] * nodes + node - first, places)
            base = place * n_bins
            for k in range(3):
                whole[k] += np.bincount(place, weights=measures[k], minlength=places + 1)
            for j, (some, bins) in zip(self.columns(), listed):
                at = (base if some is None else base[some]) + bins
                for k in range(3):
                    found = np.bincount(at, weights=measures[k] if some is None else measures[k][some])
                    out[k, j, : len(found)] += found
        out = out[:, :, :size].reshape(3, n_features, places, n_bins)
        for j in self.columns():
            if self.common[j] >= 0:
                out[:, j, :, self.common[j]] = whole[:, :places] - out[:, j].sum(axis=-1)
        out *= out[2:] > 0.5  # counts are exact: what an empty bin is left with is rounding
        return out.reshape(3, n_features, n_models, nodes, n_bins).transpose(2, 3, 0, 1, 4)

    def descend(self, level: int, grown: Mapping[str, np.ndarray]) -> None:
        """Move rows from the nodes of a level to the children those were split into."""
        at = self.model * self.settings.nodes + self.node
        feature = grown["feature"].ravel()[at]
        go = np.flatnonzero((feature >= 0) & (self.node >= 2**level - 1))
        right = self.bins[feature[go], go] > grown["split"].ravel()[at[go]]
        self.node[go] = 2 * self.node[go] + 1 + right

    def finish(self, grown: Mapping[str, np.ndarray]) -> None:
        self.margin += grown["value"].ravel()[self.model * self.settings.nodes + self.node]


def empty_tree(settings: TreeSettings, n_models: int) -> dict[str, np.ndarray]:
    shape = (n_models, settings.nodes)
    return {
        "feature": np.full(shape, -1, dtype=np.int16), "split": np.zeros(shape, dtype=np.uint8), "value": np.zeros(shape), "cover": np.zeros(shape)
    }


def split_level(settings: TreeSettings, level: int, sums: np.ndarray, allowed: np.ndarray, grown: dict[str, np.ndarray]) -> None:
    """Give the nodes of a level their best splits and their children the values that follow.

    Gains are compared in single precision, so that the order of additions cannot tell equal ones
    apart; of equal gains the first feature and then the lowest bin wins.
    """
    left = np.cumsum(sums, axis=-1)
    whole = left[..., -1:]
    right = whole - left
    # An empty side divides by nothing; it fails the limits below.
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[:, :, 0] ** 2 / left[:, :, 1] + right[:, :, 0] ** 2 / right[:, :, 1] - whole[:, :, 0] ** 2 / whole[:, :, 1]
    least = max(settings.min_rows, 1) - 0.5
    fits = (left[:, :, 2] > least) & (right[:, :, 2] > least) & (left[:, :, 1] > LEAST_CURVE) & (right[:, :, 1] > LEAST_CURVE)
    gain = np.where(fits & allowed[:, None, :, None], gain, -np.inf).astype(np.float32)
    n_models, nodes, n_features, n_bins = gain.shape
    flat = gain.reshape(n_models, nodes, -1)
    best = flat.argmax(axis=-1)
    worth = np.take_along_axis(flat, best[..., None], axis=-1)[..., 0] > 1e-10
    f, b = best // n_bins, best % n_bins
    m, n = np.indices((n_models, nodes))
    at = 2**level - 1 + n
    one, other = left[m, n, :, f, b], right[m, n, :, f, b]
    if level == 0:
        total = whole[np.arange(n_models), 0, :, allowed.argmax(axis=1), 0]  # every allowed feature has the same
        grown["value"][:, 0], grown["cover"][:, 0] = _leaf(settings, total), total[:, 2]
    grown["feature"][m[worth], at[worth]], grown["split"][m[worth], at[worth]] = f[worth], b[worth]
    for child, of in ((2 * at + 1, one), (2 * at + 2, other)):
        grown["value"][m[worth], child[worth]] = _leaf(settings, of[worth])
        grown["cover"][m[worth], child[worth]] = of[worth][..., 2]


def _leaf(settings: TreeSettings, sums: np.ndarray) -> np.ndarray:
    curve = sums[..., 1]
    return np.where(curve > 0, -settings.step * sums[..., 0] / np.where(curve > 0, curve, 1.0), 0.0)


# ------------------------------------------------------------------- blocks of rows


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, values) of a list column without null lists; null entries become NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False).astype(kind)


def _weights(rows: pa.Table, models: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Rows x models: how often each row takes part in the training set of these models."""
    y, fold = rows.column("y").to_numpy(), rows.column("fold").to_numpy()
    out = ((y[:, None] == 1) & (fold[:, None] != held[models][None, :])).astype(float)
    n, bags = _flat(rows.column("bags"), np.int64)
    n_times, times = _flat(rows.column("bags_times"), float)
    # Rows without counts were drawn once by each of their bags.
    often = np.ones(len(bags))
    often[np.repeat(n_times > 0, n)] = times
    at, inside = np.repeat(np.arange(len(y)), n), (bags >= models[0]) & (bags <= models[-1])
    out[at[inside], bags[inside] - models[0]] = often[inside]
    return out


_CELL = "variant int, part int, model int, bins binary, y binary, hash binary, weight binary"


def _cells(train: DataFrame, plan: Plan, edges: Mapping[int, Sequence[np.ndarray]], part_of: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """What the trees need of the rows of every model, packed: one row per model, part and few thousand input rows.

    ``part_of(variant, models, hashes)`` numbers the parts of a variant or bag that meet in a task. Values are binned here, so a (row, model) pair
    travels as a byte per feature and 13 more.
    """
    shared, held = train.sparkSession.sparkContext.broadcast(edges), plan.held_out_array()  # at most 255 numbers a feature
    every = np.arange(plan.n_models)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            variants = batch.column("variant").to_numpy()
            for v in np.unique(variants):
                mine = pa.Table.from_batches([batch]).filter(pa.array(variants == v))
                for s in range(0, mine.num_rows, CUT):
                    yield from cut(int(v), mine.slice(s, CUT))

    def cut(v: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        _, x = _flat(rows.column("x"), float)
        bins = binned(x.reshape(rows.num_rows, -1), shared.value[v])
        y, hashes, weight = rows.column("y").to_numpy().astype(np.uint8), rows.column("h").to_numpy().view(U), _weights(rows, every, held)
        row, model = np.nonzero(weight)
        part = part_of(v, model, hashes[row])
        order = np.lexsort((part, model))
        row, model, part = row[order], model[order], part[order]
        starts = np.flatnonzero(np.diff(model, prepend=-1) | np.diff(part, prepend=-1))
        if not len(starts):
            return
        ends = np.append(starts[1:], len(row))
        values = {"bins": bins[row], "y": y[row], "hash": hashes[row], "weight": weight[row, model].astype(np.int32)}
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(starts), v), pa.int32()), pa.array(part[starts], pa.int32()), pa.array(model[starts], pa.int32()),
             *[pa.array([a[i:j].tobytes() for i, j in zip(starts, ends)], pa.binary()) for a in values.values()]],
            names=["variant", "part", "model", *values],
        )

    return train.mapInArrow(packed, _CELL)


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind)


def _opened(cells: pa.Table, settings: TreeSettings, models: np.ndarray) -> Block:
    """A block in an order of rows that does not depend on how they came."""
    y, hashes = _joined(cells.column("y"), np.uint8), _joined(cells.column("hash"), U)
    model = np.repeat(cells.column("model").to_numpy() - models[0], pc.binary_length(cells.column("y")).to_numpy()).astype(np.int64)
    order = np.lexsort((model, hashes))
    bins = _joined(cells.column("bins"), np.uint8).reshape(len(y), -1).T
    weight = _joined(cells.column("weight"), np.int32)
    return Block(settings, models, np.ascontiguousarray(bins[:, order]), model[order], y[order].astype(float), hashes[order], weight[order].astype(float))


_MODEL = "variant int, model int, feature binary, split binary, value binary, cover binary"
_KINDS = {"feature": np.int16, "split": np.uint8, "value": np.float64, "cover": np.float64}


def _packed(variant: int, models: np.ndarray, trees: Mapping[str, np.ndarray]) -> pa.Table:
    columns = {"variant": pa.array(np.full(len(models), variant), pa.int32()), "model": pa.array(models, pa.int32())}
    for name in _KINDS:
        columns[name] = pa.array([np.ascontiguousarray(t).tobytes() for t in trees[name]], pa.binary())
    return pa.table(columns)


def _grown_whole(settings: TreeSettings, block: Block) -> dict[str, np.ndarray]:
    """All trees of the bags of one block, as models x trees x nodes."""
    trees = []
    for tree in range(settings.n_trees):
        block.start(tree)
        grown = empty_tree(settings, len(block.models))
        for level in range(settings.max_depth):
            split_level(settings, level, block.sums(level), block.allowed, grown)
            first = 2**level - 1
            if not (grown["feature"][:, first : 2 * first + 1] >= 0).any():
                break
            block.descend(level, grown)
        block.finish(grown)
        trees.append(grown)
    return {name: np.stack([t[name] for t in trees], axis=1) for name in _KINDS}


def _bag_rows(train: DataFrame, plan: Plan, variants: Sequence[int]) -> dict[int, np.ndarray]:
    """Training rows of every model, by variant: one count per (variant, fold) and per model reaches the driver."""
    held = plan.held_out_array()
    positives = {(r["variant"], r["fold"]): r["n"] for r in train.where("y = 1").groupBy("variant", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = train.where("y = 0").select("variant", F.explode("bags").alias("model")).groupBy("variant", "model").agg(F.count(F.lit(1)).alias("n")).collect()
    out = {v: np.array([sum(n for (w, f), n in positives.items() if w == v and f != h) for h in held]) for v in variants}
    for r in drawn:
        out[r["variant"]][r["model"]] += r["n"]
    return out


def fit_forests(
    train: DataFrame, features: Mapping[int, list[str]], plan: Plan, settings: TreeSettings, block_rows: int = BLOCK
) -> dict[int, Forest]:
    """All trees of every model of every variant.

    ``train`` holds ``id, variant, y, fold, bags, bags_times, x``; missing entries of ``x`` are null. A model without rows
    keeps trees of one leaf of value 0.
    """
    checkpoint_root(train.sparkSession)
    edges = bin_edges(train, features, settings.n_bins)
    sizes = _bag_rows(train, plan, list(features))
    largest = max((int(s.max(initial=0)) for s in sizes.values()), default=0)
    hashed = train.withColumn("h", F.xxhash64("id")).select("h", "variant", "y", "fold", "bags", "bags_times", "x")
    if largest <= block_rows:
        found = _fit_shared(hashed, plan, settings, edges, max(1, min(SHARED, SHARE // max(largest, 1))))
    else:
        found = _fit_divided(hashed, plan, settings, edges, sizes, min(block_rows, SHARE))
    shape = (plan.n_models, settings.n_trees, settings.nodes)
    out = {}
    for v, names in features.items():
        arrays = {n: np.zeros(shape, dtype=k) for n, k in _KINDS.items()}
        arrays["feature"][:] = -1
        for m, held in found.pop(v, {}).items():
            for n in _KINDS:
                arrays[n][m] = held[n]
        out[v] = Forest(names, plan, edges[v], **arrays)
    return out


def _fit_shared(train: DataFrame, plan: Plan, settings: TreeSettings, edges: dict, together: int) -> dict[int, dict[int, dict[str, np.ndarray]]]:
    """Bags that fit a block: each is one task's work, neighbours in number share one where they are small."""
    groups = math.ceil(plan.n_models / together)
    cells = _cells(train, plan, edges, lambda v, model, hashes: model // together)
    # More partitions than blocks, so that few blocks meet in one; empty ones cost next to nothing.
    dealt = cells.repartition(2 * groups * len(edges), "variant", "part")

    def grow(key: tuple, rows: pa.Table) -> pa.Table:
        v, g = key[0].as_py(), key[1].as_py()
        models = np.arange(g * together, min((g + 1) * together, plan.n_models))
        block = _opened(rows, settings, models)
        return _packed(v, models, _grown_whole(settings, block))

    rows = dealt.groupBy("variant", "part").applyInArrow(grow, _MODEL).toArrow().to_pylist()
    out: dict[int, dict[int, dict[str, np.ndarray]]] = {}
    for r in rows:
        out.setdefault(r["variant"], {})[r["model"]] = {
            n: np.frombuffer(r[n], dtype=k).reshape(settings.n_trees, settings.nodes) for n, k in _KINDS.items()
        }
    return out


# -------------------------------------------------------------- bags of many blocks

_STATE = _CELL + ", margin binary"
_SUMS = "variant int, model int, sums binary"


def _restored(settings: TreeSettings, row: Mapping) -> Block:
    y, weight, margin = (np.frombuffer(row[c], dtype=k).astype(float) for c, k in (("y", np.uint8), ("weight", np.int32), ("margin", float)))
    bins = np.frombuffer(row["bins"], dtype=np.uint8).reshape(-1, len(y))
    return Block(settings, np.array([row["model"]]), bins, np.zeros(len(y), dtype=np.int64), y, np.frombuffer(row["hash"], dtype=U), weight, margin)


def _one(grown: Mapping[tuple[int, int], Mapping[str, np.ndarray]], row: Mapping) -> Mapping[str, np.ndarray]:
    return grown[row["variant"], row["model"]]


def _fit_divided(
    train: DataFrame, plan: Plan, settings: TreeSettings, edges: dict, sizes: Mapping[int, np.ndarray], block_rows: int
) -> dict[int, dict[int, dict[str, np.ndarray]]]:
    """Bags of more than a block: one pass over all blocks per level.

    Blocks are written once and again every ``REWRITE`` trees, with the margins reached; between
    these a pass repeats the few trees since. A pass sends one set of sums per block, added per model.
    """
    spark = train.sparkSession
    chunks = {v: np.maximum(1, -(-s // block_rows)).astype(np.uint64) for v, s in sizes.items()}
    cells = _cells(train, plan, edges, lambda v, model, hashes: (hashes % chunks[v][model]).astype(np.int64))

    def opened(key: tuple, rows: pa.Table) -> pa.Table:
        v, m, c = (k.as_py() for k in key)
        block = _opened(rows, settings, np.array([m]))
        parts = {"bins": block.bins, "y": block.y.astype(np.uint8), "hash": block.hash, "weight": block.weight.astype(np.int32), "margin": block.margin}
        return pa.table({"variant": pa.array([v], pa.int32()), "part": pa.array([c], pa.int32()), "model": pa.array([m], pa.int32()),
                         **{n: pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for n, a in parts.items()}})

    state = cells.groupBy("variant", "model", "part").applyInArrow(opened, _STATE).checkpoint()
    trees: dict[tuple[int, int], list[dict[str, np.ndarray]]] = {(v, m): [] for v in sizes for m in range(plan.n_models)}
    n_features = {v: len(e) for v, e in edges.items()}

    def splitter(tree: int, level: int, now: Mapping):
        def split(key: tuple, rows: pa.Table) -> pa.Table:
            v, m = key[0].as_py(), key[1].as_py()
            total = np.sum([np.frombuffer(s) for s in rows.column("sums").to_pylist()], axis=0)
            grown = {n: a.copy() for n, a in now[v, m].items()}
            sums = total.reshape(1, 2**level, 3, n_features[v], settings.n_bins)
            split_level(settings, level, sums, chosen_columns(settings, tree, np.array([m]), n_features[v]), grown)
            return _packed(v, np.array([m]), grown)

        return split

    for tree in range(settings.n_trees):
        done = tree % REWRITE
        recent = {k: t[tree - done :] for k, t in trees.items()}
        grown = {k: empty_tree(settings, 1) for k in trees}
        for level in range(settings.max_depth):
            known = spark.sparkContext.broadcast((recent, grown))  # at most REWRITE trees a model

            def sums(batches: Iterator[pa.RecordBatch], known=known, tree=tree, level=level, done=done) -> Iterator[pa.RecordBatch]:
                recent, grown = known.value
                for batch in batches:
                    for row in batch.to_pylist():
                        block = _restored(settings, row)
                        _repeat(block, tree - done, _one(recent, row))
                        block.start(tree)
                        for past in range(level):
                            block.descend(past, _one(grown, row))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([row["variant"]], pa.int32()), pa.array([row["model"]], pa.int32()), pa.array([block.sums(level).tobytes()], pa.binary())],
                            names=["variant", "model", "sums"],
                        )

            parts = state.mapInArrow(sums, _SUMS)
            picked = parts.groupBy("variant", "model").applyInArrow(splitter(tree, level, grown), _MODEL).toArrow().to_pylist()
            more = False
            for r in picked:
                one = {n: np.frombuffer(r[n], dtype=k).reshape(1, settings.nodes).copy() for n, k in _KINDS.items()}
                more = more or bool((one["feature"][0, 2**level - 1 : 2 ** (level + 1) - 1] >= 0).any())
                grown[r["variant"], r["model"]] = one
            known.unpersist()
            if not more:
                break
        for k, t in trees.items():
            t.append(grown[k])
        if (tree + 1) % REWRITE == 0 and tree + 1 < settings.n_trees:
            state = _rewritten(state, settings, {k: t[tree + 1 - REWRITE :] for k, t in trees.items()}, tree + 1 - REWRITE)
    out: dict[int, dict[int, dict[str, np.ndarray]]] = {}
    for (v, m), t in trees.items():
        out.setdefault(v, {})[m] = {n: np.concatenate([g[n] for g in t]) for n in _KINDS}
    return out


def _repeat(block: Block, first: int, grown: Sequence[Mapping[str, np.ndarray]]) -> None:
    """Take a block through trees it has not seen."""
    for tree in grown:
        block.node = np.zeros(len(block.y), dtype=np.int64)
        for level in range(block.settings.max_depth):
            block.descend(level, tree)
        block.finish(tree)


def _rewritten(state: DataFrame, settings: TreeSettings, recent: Mapping, first: int) -> DataFrame:
    known = state.sparkSession.sparkContext.broadcast(recent)

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _restored(settings, row)
                _repeat(block, first, _one(known.value, row))
                row["margin"] = block.margin.tobytes()
                yield pa.RecordBatch.from_pylist([row], schema=batch.schema)

    return state.mapInArrow(moved, _STATE).checkpoint()


# --------------------------------------------------------------- forests as data


def margins(forest: Forest, bins: np.ndarray, models: np.ndarray) -> np.ndarray:
    """Rows x models: sums of the leaves that rows reach, walked level by level through all trees at once."""
    _, n_trees, nodes = forest.feature.shape
    out = np.empty((len(bins), len(models)))
    base = np.arange(n_trees) * nodes
    rows = np.arange(len(bins))[:, None]
    for j, m in enumerate(models):
        feature, split, value = (a[m].ravel() for a in (forest.feature, forest.split, forest.value))
        node = np.zeros((len(bins), n_trees), dtype=np.int64)
        for _ in range((nodes + 1).bit_length() - 2):
            at = base + node
            f = feature[at]
            step = 2 * node + 1 + (bins[rows, np.maximum(f, 0)] > split[at])
            node = np.where(f >= 0, step, node)
        out[:, j] = value[base + node].sum(axis=1)
    return out


def score_forests(rows: DataFrame, forests: Mapping[int, Forest]) -> DataFrame:
    """Bag-averaged probabilities and model counts of every row, by the rules of ``bagging.averaged``.

    Each variant's forest is shared on its own; its size follows from the settings.
    """
    parts = []
    for v, forest in forests.items():
        shared = rows.sparkSession.sparkContext.broadcast(forest)

        def probability(variant: int, x: np.ndarray, models: np.ndarray, shared=shared) -> np.ndarray:
            found = margins(shared.value, binned(x, shared.value.edges), models)
            return 1.0 / (1.0 + np.exp(-found))

        plan = {v: (forest.plan.held_out_array(), forest.plan.n_folds is not None)}
        parts.append(averaged(rows.where(F.col("variant") == v), plan, probability))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def forest_nodes(spark: SparkSession, forest: Forest) -> DataFrame:
    """(model, tree, node, feature, threshold, value, cover) of every node that rows reached."""
    threshold = forest.thresholds()
    m, t, n = np.nonzero(forest.cover > 0)
    names = np.array([*forest.features, None], dtype=object)
    import pandas as pd

    table = pd.DataFrame({
        "model": m, "tree": t, "node": n, "feature": names[forest.feature[m, t, n]], "threshold": threshold[m, t, n],
        "value": forest.value[m, t, n], "cover": forest.cover[m, t, n],
    })
    schema = "model int, tree int, node int, feature string, threshold double, value double, cover double"
    return spark.createDataFrame(table, schema).withColumn("threshold", F.when(~F.isnan("threshold"), F.col("threshold")))


def shapley(forest: Forest, bins: np.ndarray, models: Sequence[int]) -> np.ndarray:
    """Rows x features: Shapley values of the models' margins, added up over trees and models.

    Features not yet known take the share of training rows on either side. Every leaf is a product
    over the distinct features on its path, so its values follow from one polynomial: with
    features as factors ``r + o z`` (``r`` the share of rows that come through, ``o`` whether this
    row does), the coefficient of ``z^s`` holds all orders with ``s`` features known.
    """
    n_features = len(forest.features)
    out = np.zeros((len(bins), n_features))
    depth = (forest.feature.shape[2] + 1).bit_length() - 2
    weights = {
        k: np.array([math.factorial(s) * math.factorial(k - s - 1) / math.factorial(k) for s in range(k)]) for k in range(1, depth + 1)
    }
    for m in models:
        for t in range(forest.feature.shape[1]):
            feature, split, value, cover = (a[m, t] for a in (forest.feature, forest.split, forest.value, forest.cover))
            stack: list[tuple[int, dict[int, tuple[float, np.ndarray]]]] = [(0, {})]
            while stack:
                node, path = stack.pop()
                f = int(feature[node])
                if f >= 0:
                    left = bins[:, f] <= split[node]
                    share, come = path.get(f, (1.0, np.ones(len(bins), dtype=bool)))
                    for child, way in ((2 * node + 1, left), (2 * node + 2, ~left)):
                        stack.append((child, path | {f: (share * cover[child] / cover[node], come & way)}))
                    continue
                for j, (share, come) in path.items():
                    poly = [np.ones(len(bins))]
                    for i, (r, o) in path.items():
                        if i != j:
                            grown = [r * c for c in poly] + [np.zeros(len(bins))]
                            for s, c in enumerate(poly):
                                grown[s + 1] = grown[s + 1] + o * c
                            poly = grown
                    known = sum(w * c for w, c in zip(weights[len(path)], poly))
                    out[:, j] += value[node] * known * (come - share)
    return out


def forest_attribution(rows: DataFrame, forest: Forest, keep: Sequence[str], key: str, x: str = "x") -> DataFrame:
    """Mean over models of the Shapley values per feature (log-odds scale), for a short list of ``rows``.

    Models are dealt over tasks; each explains all rows of the list.
    """
    held = rows.select(key, x).toArrow()
    n, values = _flat(held.column(x), float)
    bins = binned(values.reshape(len(n), -1) if len(n) else np.zeros((0, len(forest.features))), forest.edges)
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((forest, held.column(key).combine_chunks(), bins))
    kind = rows.schema[key].dataType.simpleString()

    def explained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, keys, bins = shared.value
        for batch in batches:
            found = shapley(forest, bins, batch.column(0).to_pylist())
            at = np.repeat(np.arange(len(bins)), found.shape[1])
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(at)), pa.array(np.tile(np.arange(found.shape[1], dtype=np.int32), len(bins))), pa.array(found.ravel())],
                names=["k", "i", "v"],
            )

    n_models = forest.plan.n_models
    models = spark.range(n_models).repartition(min(n_models, spark.sparkContext.defaultParallelism * 4))
    sums = models.mapInArrow(explained, f"k {kind}, i int, v double").groupBy("k", "i").agg((F.sum("v") / n_models).alias("v"))
    names = F.array(*[F.lit(f) for f in forest.features])
    told = sums.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("c"))  # one entry per feature
    told = told.select(F.col("k").alias("__k"), F.transform("c", lambda e: F.struct(F.get(names, e["i"]).alias("feature"), e["v"].alias("value"))).alias("contributions"))
    return rows.select(key, *[c for c in keep if c != key]).join(told, F.col(key) == F.col("__k")).select(*keep, "contributions")
