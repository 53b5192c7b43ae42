"""Positive-unlabeled bagging: draws, linear base learners and scores (trees: ``boosting``).

A *model* is one (held-out fold, bag) pair, numbered ``fold * n_bags + bag``; the
final full-data run has one pseudo-fold nothing belongs to. Every model trains on all
positives outside its fold plus an equally large random draw of unlabeled rows.

Draws are decided by a hash of (seed, model, row id). Every pair is hashed once; a row keeps the few models
whose hash may be small enough. Per model only the hash of its last drawn row is needed;
with those thresholds known, membership is a per-row expression without a join.

The linear learner fits all models of all variants together: one pass over the
training rows adds up gradient and curvature per model (a few hundred numbers each),
and the driver solves the small penalised systems. What travels depends on the
number of models and features, never on the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.digests import leading_md5
from evidentia.operators.ordering import quantiles, row_rank, seeded_key
from evidentia.session import checkpoint_root

# Penalty mix and inverse strength of the linear learner.
L1_RATIO, C = 0.5, 1.0
_CHUNK = 4096
_ROWS = 1 << 14  # rows of a variant that a pass adds up at once, at most
_BUCKETS = 256  # of a feature's values, to find medians in


@dataclass(frozen=True)
class Plan:
    """Which models exist: ``n_folds`` held-out folds (or the full run) x ``n_bags``."""

    n_bags: int
    n_folds: int | None  # None: one run on all rows
    seed: int

    @property
    def outer(self) -> int:
        return self.n_folds or 1

    @property
    def n_models(self) -> int:
        return self.outer * self.n_bags

    def held_out(self, model: Column) -> Column:
        """Fold a model leaves out; -1 for the full run."""
        if self.n_folds is None:
            return F.lit(-1)
        return F.floor(model / F.lit(self.n_bags)).cast("int")

    def held_out_array(self) -> np.ndarray:
        if self.n_folds is None:
            return np.full(self.n_models, -1)
        return np.repeat(np.arange(self.n_folds), self.n_bags)


def _draw(plan: Plan, model: Column, row_id: str) -> Column:
    return seeded_key(plan.seed, model, row_id)


def draw_sizes(df: DataFrame, label: str, fold: str | None, plan: Plan) -> list[tuple[int, int]]:
    """(positives, unlabeled) available to each outer split."""
    held = F.col(fold) if fold else F.lit(-1)
    rows = df.groupBy(held.alias("f")).agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("u")
    ).collect()  # one row per fold
    by_fold = {r["f"]: (r["p"], r["u"]) for r in rows}
    pos, unl = sum(p for p, _ in by_fold.values()), sum(u for _, u in by_fold.values())
    if plan.n_folds is None:
        return [(pos, unl)]
    return [(pos - by_fold.get(f, (0, 0))[0], unl - by_fold.get(f, (0, 0))[1]) for f in range(plan.n_folds)]


_HASHED = "struct<model:array<int>,key:array<bigint>>"
_LOW = 1 << 63  # keys are the leading eight bytes of a hash, moved so that signed numbers keep their order


def _bound(prefix: str) -> int:
    """The number that leading bytes of a hash stay below if and only if the hash sorts before ``prefix``."""
    return 1 << 64 if prefix == "g" else int(prefix.ljust(16, "0")[:16], 16)


def _hashed(df: DataFrame, row_id: str, label: str, fold: str | None, plan: Plan, cut: Sequence[str]) -> DataFrame:
    """Add ``__hashed``: the models for which an unlabeled row's hash is below the cut of their outer split, and these hashes' keys."""
    held, width = plan.held_out_array(), {}
    bounds = [_bound(cut[max(int(h), 0)]) for h in held]
    most = np.array([max(b - 1, 0) for b in bounds], dtype=np.uint64)
    for m in (m for m, b in enumerate(bounds) if b):
        width.setdefault(len(str(m)), []).append(m)
    seed = plan.seed

    @F.arrow_udf(_HASHED)
    def hashed(unlabeled: pa.Array, own: pa.Array, tail: pa.Array) -> pa.Array:
        open_ = unlabeled.fill_null(False).to_numpy(zero_copy_only=False) & own.is_valid().to_numpy(zero_copy_only=False)
        folds = own.fill_null(-2).to_numpy(zero_copy_only=False)
        tail = tail.cast(pa.large_binary())
        starts, data = (np.frombuffer(b, k) if b else np.zeros(1, k) for b, k in zip(tail.buffers()[1:], (np.int64, np.uint8)))
        starts = starts[tail.offset:tail.offset + len(tail) + 1]
        sizes = np.diff(starts)
        # Rows of one fold and one length are hashed together.
        kind = folds.astype(np.int64) * (int(sizes.max(initial=0)) + 1) + sizes
        found = []
        for k in np.unique(kind[open_]):
            rows = np.flatnonzero(open_ & (kind == k))
            texts = data[starts[rows][:, None] + np.arange(sizes[rows[0]])]
            for some in width.values():
                models = np.array([m for m in some if held[m] != folds[rows[0]]], dtype=np.int32)
                if len(models):
                    keys = leading_md5([f"{seed}:{m}".encode() for m in models], texts)
                    m, r = np.nonzero(keys <= most[models][:, None])
                    found.append((rows[r], models[m], keys[m, r]))
        row, model, key = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, t) for i, t in enumerate((np.int64, np.int32, np.uint64)))
        order = np.lexsort((model, row))
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(tail)))]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (model[order], (key[order] ^ np.uint64(_LOW)).view(np.int64))]
        return pa.StructArray.from_arrays(lists, ["model", "key"])

    own = F.col(fold).cast("int") if fold else F.lit(-2)
    tail = F.concat_ws(":", F.lit(""), F.col(row_id).cast("string"))
    return df.withColumn("__hashed", hashed(F.col(label) == 0, own, tail))


def _cut(wanted: int, pool: int) -> str:
    """Hash prefix expected to admit ``wanted`` rows with a margin of eight deviations."""
    if pool == 0:
        return "g"
    p = (wanted + 8.0 * np.sqrt(wanted) + 16.0) / pool
    return "g" if p >= 1.0 else f"{int(p * 2 ** 32):08x}"


def _start(wanted: int, pool: int) -> str:
    """Hash prefix expected to admit fewer than ``wanted`` rows, by the same margin."""
    p = (wanted - 8.0 * np.sqrt(wanted) - 16.0) / max(pool, 1)
    return "" if p <= 0.0 else f"{int(min(p, 1.0 - 2.0 ** -32) * 2 ** 32):08x}"


def draws(df: DataFrame, row_id: str, label: str, fold: str | None, plan: Plan) -> DataFrame:
    """(model, id): exactly n_pos distinct unlabeled rows per model.

    Rows clearly inside by their hash are only counted; those around the last one drawn are
    ranked. Should a model's last row ever lie elsewhere, all its rows are ranked.
    When a pool is smaller than n_pos, its whole pool is taken.
    """
    hashed, member = _membership(df, row_id, label, fold, plan, draw_sizes(df, label, fold, plan))
    return hashed.select(F.explode(member).alias("model"), F.col(row_id).alias("id"))


def _membership(df, row_id, label, fold, plan, sizes) -> tuple[DataFrame, Column]:
    """Rows with ``__hashed``, written down so that they are hashed once, and the models that drew each."""
    checkpoint_root(df.sparkSession)
    wanted = [min(sizes[max(h, 0)]) for h in plan.held_out_array()]
    targets = F.array(*[F.lit(int(n)) for n in wanted])

    def search(cuts: list[str], starts: list[str]) -> tuple[DataFrame, dict[int, str]]:
        hashed = _hashed(df, row_id, label, fold, plan, cuts).checkpoint()
        pairs = F.arrays_zip(F.col("__hashed.model").alias("model"), F.col("__hashed.key").alias("key"))
        entries = hashed.select(F.col(row_id).alias("id"), F.inline(pairs))
        start = F.get(F.array(*[F.lit(_bound(starts[max(int(h), 0)]) - _LOW) for h in plan.held_out_array()]), F.col("model"))
        below = {}
        if any(starts):
            inside = entries.filter(F.col("key") < start)
            below = {r["model"]: r["n"] for r in inside.groupBy("model").agg(F.count(F.lit(1)).alias("n")).collect()}
        near = entries.filter(F.col("key") >= start).select("id", "model", _draw(plan, F.col("model"), "id").alias("draw"))
        ranked = row_rank(near, [("draw", "asc"), ("id", "asc")], ["model"], "place")
        counted = F.array(*[F.lit(int(below.get(m, 0))) for m in range(plan.n_models)])
        last = ranked.filter(F.col("place") + F.get(counted, F.col("model")) == F.get(targets, F.col("model")))
        return hashed, {r["model"]: r["draw"] for r in last.select("model", "draw").collect()}  # one row per model

    hashed, found = search([_cut(p, u) for p, u in sizes], [_start(min(p, u), u) for p, u in sizes])
    if any(n > 0 and m not in found for m, n in enumerate(wanted)):
        hashed, found = search(["g"] * len(sizes), [""] * len(sizes))
    last = [found.get(m, "") for m in range(plan.n_models)]
    edges, keys = F.array(*[F.lit(e) for e in last]), F.array(*[F.lit(_bound(e) - _LOW) for e in last])

    def drawn(m: Column, i: Column) -> Column:
        key, edge = F.get("__hashed.key", i), F.get(keys, m)
        return (key < edge) | ((key == edge) & (_draw(plan, m, row_id) <= F.get(edges, m)))

    return hashed, F.filter("__hashed.model", drawn)


def with_membership(
    df: DataFrame, row_id: str, label: str, fold: str | None, plan: Plan, name: str = "bags"
) -> DataFrame:
    """Add ``<name>``: the models that drew each unlabeled row, and ``<name>_times``.

    ``_times`` holds how often each of them drew it; it is empty when all draws are single.
    """
    sizes = draw_sizes(df, label, fold, plan)
    held = plan.held_out_array()
    hashed, member = _membership(df, row_id, label, fold, plan, sizes)
    short = [m for m, h in enumerate(held) if sizes[max(h, 0)][1] < sizes[max(h, 0)][0]]
    none = F.array().cast("array<int>")
    out = hashed.withColumns({name: member, f"{name}_times": none}).drop("__hashed")
    if not short:
        return out
    return _with_replacement(out, row_id, label, fold, plan, name, short, sizes)


def _with_replacement(df, row_id, label, fold, plan, name, short, sizes):
    """Models whose pool is smaller than their draw pick rows with replacement.

    The pool of a held-out fold is numbered once, each draw hashes to a number, and the
    two meet in an equi-join. Repeats are counted before rows are listed, so a row's
    list never exceeds the number of models.
    """
    held = plan.held_out_array()
    split_of = [max(int(h), 0) for h in held]
    splits = sorted({split_of[m] for m in short})
    outside = F.col(fold) if fold else F.lit(-2)
    pool = df.filter(F.col(label) == 0).select(
        F.col(row_id).alias("id"), outside.alias("f"), F.explode(F.array(*[F.lit(s) for s in splits])).alias("split")
    )
    if plan.n_folds is not None:
        pool = pool.filter(F.col("f") != F.col("split"))
    pool = row_rank(pool, [("id", "asc")], ["split"], "number")
    ask = F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(split_of[m]).alias("split"),
                 F.lit(sizes[split_of[m]][0]).alias("want"), F.lit(sizes[split_of[m]][1]).alias("have"))
        for m in short
    ])
    picks = (
        df.sparkSession.range(max(sizes[s][0] for s in splits)).select(F.col("id").alias("j"), F.explode(ask).alias("a"))
        .select("j", "a.*").filter("j < want and have > 0")
        .withColumn("number", F.conv(F.substring(seeded_key(plan.seed, "model", "j"), 1, 12), 16, 10).cast("bigint") % F.col("have") + 1)
        .groupBy("model", "split", "number").agg(F.count(F.lit(1)).cast("int").alias("n"))
    )
    extra = picks.join(pool, ["split", "number"]).groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("model", "n"))).alias("__again"))
    joined = df.join(extra, F.col(row_id) == F.col("id"), "left")
    plain = F.filter(name, lambda m: ~m.isin(*short))
    again = F.coalesce("__again", F.array().cast("array<struct<model:int,n:int>>"))
    return joined.withColumns({
        name: F.concat(plain, again["model"]),
        f"{name}_times": F.concat(F.transform(plain, lambda m: F.lit(1)), again["n"]),
    }).select(*df.columns)


# --------------------------------------------------------------------------- linear


@dataclass
class LinearModels:
    """Fitted coefficients of every model of one variant, on the raw feature scale.

    Rows hold 0 for a missing value and, behind the features, a flag for each of ``missing``;
    a flag stands for the model's own fill, so filling stays linear in what rows hold.
    """

    features: list[str]
    plan: Plan
    coef: np.ndarray  # models x features
    intercept: np.ndarray  # models
    mean: np.ndarray  # models x features: training mean, for attribution
    missing: Sequence[int] = ()  # features with a flag
    fill: np.ndarray | None = None  # models x flags

    def slopes(self) -> np.ndarray:
        """Models x (features and flags)."""
        if not len(self.missing):
            return self.coef
        return np.concatenate([self.coef, self.coef[:, list(self.missing)] * self.fill], axis=1)


def _weights(part: pd.DataFrame, held: np.ndarray) -> np.ndarray:
    """Rows x models: how often each row takes part in each model's training set."""
    y, fold = part["y"].to_numpy(), part["fold"].to_numpy()
    out = ((y[:, None] == 1) & (fold[:, None] != held[None, :])).astype(float)
    bags, times = part["bags"].to_numpy(), part["bags_times"].to_numpy()
    n = np.fromiter(map(len, bags), dtype=np.int64, count=len(bags))
    if n.any():
        often = [t if len(t) else np.ones(k) for t, k in zip(times, n) if k]
        out[np.repeat(np.arange(len(part)), n), np.concatenate([b for b in bags if len(b)]).astype(int)] = np.concatenate(often)
    return out


@dataclass
class Takes:
    """Which rows of a block take part in which models: rows and weights in order of model, which ends at ``ends``."""

    ends: np.ndarray
    row: np.ndarray
    weight: np.ndarray

    def of(self, model: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.ends[model], self.ends[model + 1])
        return self.row[at], self.weight[at]

    def models(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ends) - 1), np.diff(self.ends))


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, values) of a list column."""
    whole = column.combine_chunks()
    return whole.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), whole.flatten().to_numpy(zero_copy_only=False)


def _taking(rows: pa.Table, held: np.ndarray) -> Takes:
    """As ``_weights``, pair by pair; positives have no bags of their own."""
    y, fold = rows.column("y").to_numpy(), rows.column("fold").to_numpy()
    positive = np.flatnonzero(y == 1)
    model, at = np.nonzero(held[:, None] != fold[positive][None, :])
    n, bags = _lists(rows.column("bags"))
    n_times, times = _lists(rows.column("bags_times"))
    often = np.ones(len(bags))
    often[np.repeat(n_times > 0, n)] = times
    models = np.concatenate([model, bags]).astype(np.int32)
    order = np.argsort(models, kind="stable")
    row = np.concatenate([positive[at], np.repeat(np.arange(len(y)), n)])[order]
    weight = np.concatenate([np.ones(len(at)), often])[order]
    return Takes(np.concatenate([[0], np.cumsum(np.bincount(models, minlength=len(held)))]), row, weight)


def _blocks(batches: Iterator[pa.RecordBatch], held: Mapping[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, Takes]]:
    """(variant, x, y, takes) of at most ``_ROWS`` training rows of a variant at once, from batches of any size."""
    waiting: dict[int, list[pa.RecordBatch]] = {}

    def whole(v: int) -> tuple[int, np.ndarray, np.ndarray, Takes]:
        rows = pa.Table.from_batches(waiting.pop(v))
        _, x = _lists(rows.column("x"))
        return v, x.astype(float).reshape(rows.num_rows, -1), rows.column("y").to_numpy().astype(float), _taking(rows, held[v])

    for batch in batches:
        variants = batch.column("variant").to_numpy()
        for v in np.unique(variants):
            mine = batch.filter(pa.array(variants == v))
            for s in range(0, mine.num_rows, _CHUNK):
                held_back = waiting.setdefault(int(v), [])
                held_back.append(mine.slice(s, _CHUNK))
                if sum(b.num_rows for b in held_back) > _ROWS - _CHUNK:
                    yield whole(int(v))
    for v in list(waiting):
        yield whole(v)


_TRAIN = ["variant", "y", "fold", "bags", "bags_times", "x"]


def _bucket_edges(train: DataFrame, features: Mapping[int, list[str]], missing: Mapping[int, Sequence[int]]) -> dict[int, list[np.ndarray]]:
    """Values that cut each flagged feature of each variant into about equal buckets; they decide on the work, not on the medians."""
    none = F.array().cast("array<struct<flag:int,v:double>>")
    values = none
    for v, at in missing.items():
        p = len(features[v])
        known = [F.struct(F.lit(k).alias("flag"), F.when(F.get("x", F.lit(p + k)) == 0, F.get("x", F.lit(j))).alias("v")) for k, j in enumerate(at)]
        values = F.when(F.col("variant") == v, F.array(*known) if known else none).otherwise(values)
    long = train.select("variant", F.inline(values)).where("v IS NOT NULL AND NOT isnan(v)")
    cuts = F.percentile_approx("v", [i / _BUCKETS for i in range(1, _BUCKETS)], 4 * _BUCKETS)
    out = {v: [np.zeros(0)] * len(at) for v, at in missing.items()}
    for r in long.groupBy("variant", "flag").agg(cuts.alias("cuts")).collect():
        out[r["variant"]][r["flag"]] = np.unique(r["cuts"])
    return out


def _buckets(x: np.ndarray, at: Sequence[int], edges: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Per flagged feature the bucket of every row, -1 where the value is not known."""
    p = x.shape[1] - len(at)
    return [np.where(x[:, p + k] == 0, np.searchsorted(e, x[:, j], side="left"), -1) for k, (j, e) in enumerate(zip(at, edges))]


def bag_medians(train: DataFrame, features: Mapping[int, list[str]], plan: Plan, missing: Mapping[int, Sequence[int]]) -> DataFrame:
    """(variant, model, feature, median): medians of each model's own training rows, drawn rows as often as drawn.

    A pass counts every model's values by bucket, which says where its middle lies; only the values of
    that bucket are sent and ranked. No held-out row takes part. ``x`` of ``train``
    holds the features and then a flag for each of ``missing`` that is 1 where the value is not known.
    """
    spark = train.sparkSession
    edges = _bucket_edges(train, features, missing)
    held = {v: plan.held_out_array() for v in missing}
    starts = {v: np.cumsum([0] + [len(e) + 1 for e in es]) for v, es in edges.items()}

    def counts(v, x, y, takes):
        out, model = np.zeros((len(takes.ends) - 1, starts[v][-1])), takes.models()
        for k, bucket in enumerate(_buckets(x, missing[v], edges[v])):
            mine, size = bucket[takes.row], len(edges[v][k]) + 1
            some = np.flatnonzero(mine >= 0)
            found = np.bincount(model[some] * size + mine[some], weights=takes.weight[some], minlength=len(out) * size)
            out[:, starts[v][k]:starts[v][k + 1]] = found.reshape(-1, size)
        return out

    windows = {}
    for v, all_counts in _pass(train.filter(F.col("variant").isin([v for v, at in missing.items() if len(at)])), held, counts).items():
        for k in range(len(missing[v])):
            upto = np.cumsum(all_counts.reshape(plan.n_models, -1)[:, starts[v][k]:starts[v][k + 1]], axis=1)
            n = upto[:, -1]
            first, last = ((upto > half[:, None]).argmax(1) for half in (np.floor((n - 1) / 2), np.ceil((n - 1) / 2)))
            below = np.where(first > 0, np.take_along_axis(upto, np.maximum(first - 1, 0)[:, None], 1)[:, 0], 0)
            windows[v, k] = first, np.where(n > 0, last, -1), below.astype(np.int64), n.astype(np.int64)
    shared = spark.sparkContext.broadcast((held, edges, windows))  # a few numbers per model and feature

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, edges, windows = shared.value
        for v, x, _, takes in _blocks(batches, held):
            model = takes.models()
            for k, bucket in enumerate(_buckets(x, missing[v], edges[v])):
                first, last, below, total = windows[v, k]
                mine = bucket[takes.row]
                some = np.flatnonzero((mine >= 0) & (mine >= first[model]) & (mine <= last[model]))
                # Equal values of a block and model are one row.
                values, number = np.unique(x[:, missing[v][k]], return_inverse=True)
                code, at = np.unique(model[some] * len(values) + number[takes.row[some]], return_inverse=True)
                m = code // max(len(values), 1)
                yield pa.RecordBatch.from_pydict({
                    "variant": np.full(len(code), v, np.int32), "model": m.astype(np.int32), "feature": np.full(len(code), missing[v][k], np.int32),
                    "v": values[code % max(len(values), 1)], "times": np.bincount(at, weights=takes.weight[some], minlength=len(code)).astype(np.int64),
                    "below": below[m], "total": total[m],
                })

    near = train.select(*_TRAIN).mapInArrow(around, "variant int, model int, feature int, v double, times bigint, below bigint, total bigint")
    return quantiles(near, "v", {"median": 0.5}, ["variant", "model", "feature"], F.col("times"), ("below", "total"))


def _fills(train: DataFrame, features: dict[int, list[str]], plan: Plan, missing: Mapping[int, Sequence[int]]) -> dict[int, np.ndarray]:
    """Models x flags per variant; 0 where a model knows no value. One number per model and flag reaches the driver."""
    out = {v: np.zeros((plan.n_models, len(at))) for v, at in missing.items()}
    if any(len(at) for at in missing.values()):
        for r in bag_medians(train, features, plan, missing).collect():
            out[r["variant"]][r["model"], list(missing[r["variant"]]).index(r["feature"])] = r["median"]
    return out


_SUMS = "variant int, model int, sums array<double>"


def _pass(train: DataFrame, held: dict[int, np.ndarray], kernel) -> dict[int, np.ndarray]:
    """Run ``kernel`` over all training rows; add up its per-model sums.

    Partials leave a task once, are added by Spark per (variant, model) and reach the
    driver as one short array per model.
    """
    shared = train.sparkSession.sparkContext.broadcast(held)

    def sent(v: int, models: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        ends = np.arange(len(sums) + 1, dtype=np.int32) * sums.shape[1]
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(sums, dtype=float).ravel()))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(sums), v, np.int32)), pa.array(models.astype(np.int32)), lists], ["variant", "model", "sums"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for v, x, y, takes in _blocks(batches, shared.value):
            got = kernel(v, x, y, takes)
            totals[v] = totals[v] + got if v in totals else got
        for v, sums in totals.items():
            yield sent(v, np.arange(len(sums)), sums)

    def add_up(key: tuple, rows: pa.Table) -> pa.Table:
        _, sums = _lists(rows.column("sums"))
        return pa.Table.from_batches([sent(key[0].as_py(), np.array([key[1].as_py()]), sums.reshape(rows.num_rows, -1).sum(axis=0)[None])])

    parts = train.select(*_TRAIN).mapInArrow(partial, _SUMS).groupBy("variant", "model").applyInArrow(add_up, _SUMS)
    out: dict[int, list] = {v: [0.0] * len(h) for v, h in held.items()}
    for r in parts.toArrow().to_pandas().itertuples(index=False):
        out[r.variant][r.model] = out[r.variant][r.model] + np.asarray(r.sums)
    shared.unpersist()
    return {v: np.stack([np.asarray(a, dtype=float) for a in rows]) for v, rows in out.items()}


def _penalised_minimum(h, g, b, sd):
    """Minimise the penalised quadratic model of many fits at once.

    A few coordinate steps give a first guess which coefficients are zero; an active-set search ends
    at the minimum itself. Given signs, the coefficients solve a linear system. A fit goes there
    unless a coefficient would change its sign on the way: there it stops and that one is zero from
    then on. A fit that has arrived takes in the zero coefficient that most wants to move, until
    none does. Every step goes down, so no set comes twice, however alike columns are: the coordinate
    steps alone are slower the more rows stand against the fixed penalty. A fit that runs out of rounds keeps
    its last step, which is a step down all the same: the caller goes on from it, and raises if its passes do not converge.
    """
    k = b.shape[1]
    p = k - 1
    l1, l2 = L1_RATIO / C * sd, (1.0 - L1_RATIO) / C * sd**2
    target = np.einsum("mij,mj->mi", h, b) - g
    ridge = np.concatenate([l2, np.full((len(b), 1), 1e-12)], axis=1)
    lasso = np.concatenate([l1, np.zeros((len(b), 1))], axis=1)
    x = b.copy()
    pull = target - np.einsum("mij,mj->mi", h, x)
    for _ in range(3):
        for j in range(k):
            curve = np.maximum(h[:, j, j], 1e-12)
            aim = pull[:, j] + curve * x[:, j]
            fit = np.sign(aim) * np.maximum(np.abs(aim) - lasso[:, j], 0.0) / (curve + ridge[:, j])
            pull -= h[:, :, j] * (fit - x[:, j])[:, None]
            x[:, j] = fit
    sign = np.sign(x)
    sign[:, p] = 1.0
    # Below this a pull is rounding of the sums it is the rest of.
    blur = 8.0 * k * np.finfo(float).eps
    todo, diag = np.arange(len(b)), np.arange(k)
    for _ in range(20 * k):
        ht, ct, xt, st = h[todo], target[todo], x[todo], sign[todo]
        on = st != 0
        system = np.where(on[:, :, None] & on[:, None, :], ht, 0.0)
        system[:, diag, diag] += np.where(on, ridge[todo], 1.0)
        y = np.linalg.solve(system, np.where(on, ct - lasso[todo] * st, 0.0)[:, :, None])[:, :, 0]
        turns = on & (y * st < 0)
        turns[:, p] = False
        # How far along the way each coefficient that changes its sign is zero.
        way = np.where(turns, xt / np.where(turns, xt - y, 1.0), 2.0)
        first = way.argmin(1)
        stopped = turns.any(1)
        share = np.where(stopped, way.min(1), 1.0)
        xt = np.where(stopped[:, None], xt + share[:, None] * (y - xt), y)
        xt[np.flatnonzero(stopped), first[stopped]] = 0.0
        st[np.flatnonzero(stopped), first[stopped]] = 0.0
        xt[:, :p] = np.where(xt[:, :p] * st[:, :p] > 0, xt[:, :p], 0.0)
        pull = ct - np.einsum("mij,mj->mi", ht, xt)
        least = lasso[todo] * (1 + 1e-9) + 1e-9 + blur * (np.abs(ct) + np.einsum("mij,mj->mi", np.abs(ht), np.abs(xt)))
        wants = np.where(on, -np.inf, np.abs(pull) - least)
        wants[stopped] = -np.inf
        more = wants.argmax(1)
        moves = np.take_along_axis(wants, more[:, None], 1)[:, 0] > 0
        at = np.flatnonzero(moves)
        st[at, more[at]] = np.sign(pull[at, more[at]])
        x[todo], sign[todo] = xt, st
        todo = todo[stopped | moves]
        if not len(todo):
            break
    return x


def fit_linear(
    train: DataFrame, features: dict[int, list[str]], plan: Plan, missing: Mapping[int, Sequence[int]] | None = None,
    tol: float = 1e-5, max_passes: int = 40,
) -> dict[int, LinearModels]:
    """Elastic-net logistic fits of every model of every variant.

    ``train`` holds ``variant, y, fold, bags, bags_times, x``; ``x`` holds the features and a flag for
    each of ``missing``. Newton steps with step halving; a pass over the rows also yields the objective
    that accepts or shortens the step. As a pipeline of imputer and scaler would, each model
    fills a missing value with the median of its own training rows and scales by them. Sums are
    kept over features and flags; what a model fills in is put in their place afterwards.
    """
    missing = {v: list((missing or {}).get(v, ())) for v in features}
    held = {v: plan.held_out_array() for v in features}
    fill = _fills(train, features, plan, missing)

    def moments(v, x, y, takes):
        each = np.concatenate([np.ones((len(x), 1)), x, x * x], axis=1)
        out = np.zeros((len(takes.ends) - 1, each.shape[1]))
        for m in np.flatnonzero(np.diff(takes.ends)):
            at, weight = takes.of(m)
            out[m] = weight @ each[at]
        return out

    base = _pass(train, held, moments)
    centre, scale, sd, mean, put = {}, {}, {}, {}, {}
    for v, m in base.items():
        p, at = len(features[v]), missing[v]
        n = np.maximum(m[:, :1], 1.0)
        first, second = m[:, 1:p + 1].copy(), m[:, p + len(at) + 1:2 * p + len(at) + 1].copy()
        flags = m[:, p + 1:p + len(at) + 1]
        first[:, at] += flags * fill[v]
        second[:, at] += flags * fill[v] ** 2
        mean[v] = first / n
        total = np.maximum(m[:, 0].sum(), 1.0)
        centre[v] = first.sum(0) / total
        spread = np.sqrt(np.maximum(second.sum(0) / total - centre[v] ** 2, 0.0))
        scale[v] = np.where(spread > 1e-12, spread, 1.0)
        own = np.sqrt(np.maximum(second / n - mean[v] ** 2, 0.0)) / scale[v]
        sd[v] = np.where(own > 1e-9, own, 1.0)  # a constant column is left unscaled
        # From what rows hold (features, flags, 1) to the scaled columns of each model. A row without
        # a value holds 0, so a flag moves it from the scaled 0 to the scaled fill.
        put[v] = np.zeros((plan.n_models, p + 1, p + len(at) + 1))
        put[v][:, np.arange(p + 1), np.append(np.arange(p), p + len(at))] = 1.0
        for k, j in enumerate(at):
            put[v][:, j, p + k] = fill[v][:, k] / scale[v][j]

    def kernel(coef):
        held_in = {v: np.einsum("mij,mi->mj", put[v], b) for v, b in coef.items()}
        sizes, middle, spread = {v: len(f) for v, f in features.items()}, centre, scale

        def newton(v, x, y, takes):
            p = sizes[v]
            z = np.concatenate([(x[:, :p] - middle[v]) / spread[v], x[:, p:], np.ones((len(x), 1))], axis=1)
            k = z.shape[1]
            out = np.zeros((len(takes.ends) - 1, 1 + k + k * k))
            # An unlabeled row takes part in few models, so each model's sums run over its own rows.
            for m in np.flatnonzero(np.diff(takes.ends)):
                at, wm = takes.of(m)
                zm, ym = z[at], y[at]
                eta = np.clip(zm @ held_in[v][m], -500, 500)
                far = np.exp(-np.abs(eta))
                prob = np.where(eta < 0, far, 1.0) / (1.0 + far)
                out[m, 0] = wm @ (np.maximum(eta, 0.0) + np.log1p(far) - ym * eta)
                out[m, 1:k + 1] = (wm * (prob - ym)) @ zm
                zm *= np.sqrt(wm * prob * (1.0 - prob))[:, None]
                out[m, k + 1:] = (zm.T @ zm).ravel()
            return out
        return newton

    def penalty(v, b):
        raw = sd[v] * b[:, :-1]
        return (0.5 * (1 - L1_RATIO) * raw**2 + L1_RATIO * np.abs(raw)).sum(1) / C

    best = {v: np.zeros((plan.n_models, len(f) + 1)) for v, f in features.items()}
    trial = {v: b.copy() for v, b in best.items()}
    value = {v: np.full(plan.n_models, np.inf) for v in features}
    live = set(features)
    for _ in range(max_passes):
        rows = train if live == set(features) else train.filter(F.col("variant").isin(*live))
        sums = _pass(rows, {v: held[v] for v in live}, kernel({v: trial[v] for v in live}))
        for v in list(live):
            k = put[v].shape[2]
            s = sums[v]
            now = s[:, 0] + penalty(v, trial[v])
            worse = now > value[v] + 1e-9 * np.abs(now)
            ok = ~worse
            best[v][ok], value[v][ok] = trial[v][ok], now[ok]
            curve = np.einsum("mij,mjk,mlk->mil", put[v], s[:, k + 1:].reshape(-1, k, k), put[v])
            ahead = _penalised_minimum(curve, np.einsum("mij,mj->mi", put[v], s[:, 1:k + 1]), trial[v], sd[v])
            half = 0.5 * (trial[v] + best[v])
            move = np.where(worse[:, None], half, ahead)
            change = np.max(np.abs(move - best[v]))
            trial[v] = move
            if change < tol:
                best[v] = move
                live.discard(v)
        if not live:
            break
    else:
        raise ArithmeticError(f"variants {sorted(live)} did not converge in {max_passes} passes")
    out = {}
    for v, f in features.items():
        coef = best[v][:, :-1] / scale[v]
        out[v] = LinearModels(f, plan, coef, best[v][:, -1] - coef @ centre[v], mean[v], missing[v], fill[v])
    return out


_SCORE = "score double, oob_models bigint, inbag_models bigint"


def averaged(rows: DataFrame, plans: dict[int, tuple[np.ndarray, bool]], probability) -> DataFrame:
    """Add the bag-averaged probability and model counts to every row.

    ``rows`` holds ``variant, y, fold, bags, bags_times, x`` beside any other columns,
    which never leave the JVM. ``plans`` gives, per variant, the fold each model held out and
    whether that is cross-validation; ``probability(variant, x, models)`` is rows x models.
    Under cross-validation a row is scored by the models that held its fold out. In the full
    run an unlabeled row is scored by the models that did not draw it, falling back to
    all when every model did; a positive takes part in all of them and is scored by all.
    """

    def crossed(v: int, held: np.ndarray, part: pd.DataFrame) -> pd.DataFrame:
        pieces = []
        for fold, some in part.groupby("fold", sort=False):
            models = np.flatnonzero(held == fold)
            mean = probability(v, _matrix(some), models).mean(1) if len(models) else np.full(len(some), np.nan)
            pieces.append(pd.DataFrame({"score": mean, "oob_models": len(models), "inbag_models": 0}, index=some.index))
        return pd.concat(pieces)

    def block(v: int, part: pd.DataFrame) -> pd.DataFrame:
        held, is_crossed = plans[v]
        if is_crossed:
            return crossed(v, held, part)
        prob = probability(v, _matrix(part), np.arange(len(held)))
        inside = _weights(part, held) > 0
        use = ~inside
        use[~use.any(1)] = True
        count = use.sum(1)
        mean = np.divide((prob * use).sum(1), count, out=np.full(len(part), np.nan), where=count > 0)
        return pd.DataFrame(
            {"score": mean, "oob_models": (use & ~inside).sum(1), "inbag_models": inside.sum(1)}, index=part.index)

    @F.pandas_udf(_SCORE)
    def score(variant: pd.Series, y: pd.Series, fold: pd.Series, bags: pd.Series, bags_times: pd.Series,
              x: pd.Series) -> pd.DataFrame:
        pdf = pd.DataFrame({"variant": variant, "y": y, "fold": fold, "bags": bags, "bags_times": bags_times, "x": x})
        parts = [block(int(v), part.iloc[s:s + _CHUNK]) for v, part in pdf.groupby("variant", sort=False)
                 for s in range(0, len(part), _CHUNK)]
        return pd.concat(parts).reindex(pdf.index)

    got = rows.withColumn("__s", score("variant", "y", "fold", "bags", "bags_times", "x"))
    unscored = F.raise_error(F.lit("a row was never in a scored fold")).cast("double")
    value = F.col("__s.score")
    return got.withColumns({
        "score": F.when(value.isNull() | F.isnan(value), unscored).otherwise(value),
        "oob_models": F.col("__s.oob_models"), "inbag_models": F.col("__s.inbag_models"),
    }).drop("__s")


def _matrix(part: pd.DataFrame) -> np.ndarray:
    return np.stack(part["x"].to_numpy()).astype(float)


def score_linear(rows: DataFrame, models: dict[int, LinearModels]) -> DataFrame:
    """Bag-averaged probabilities of linear models, by the rules of ``averaged``."""
    shared = rows.sparkSession.sparkContext.broadcast({v: (m.slopes(), m.intercept) for v, m in models.items()})

    def probability(v: int, x: np.ndarray, use: np.ndarray) -> np.ndarray:
        coef, intercept = shared.value[v]
        return 1.0 / (1.0 + np.exp(-np.clip(x @ coef[use].T + intercept[use], -500, 500)))

    return averaged(rows, {v: (m.plan.held_out_array(), m.plan.n_folds is not None) for v, m in models.items()}, probability)
