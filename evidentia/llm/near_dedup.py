"""Near-dedup by DartMinHash signatures.

A document is a bag of word shingles; each occurrence is a region of unit weight. Darts fall on
a region in the order of their ranks, as a hashed Poisson process in which every dart also has
a coordinate of the signature. A document sees the darts on its own regions and keeps the
earliest one per coordinate, so two documents agree in a coordinate with the probability of
their weighted Jaccard similarity. Only ranks up to a limit that falls with the document's
weight are thrown, about ``t ln t`` darts for ``t`` coordinates whatever its length; the rare
coordinate left empty makes that document throw again with a higher limit, which adds later
darts and changes none of the earlier ones.

Signatures are cut into bands. Documents that share a band meet in its bucket, and are compared
there with two pivots of the bucket by exact weighted Jaccard similarity of whole texts. Linked
documents form classes. A bucket whose other members still belong to several classes is completed in
tiles of bounded size: members of different classes are compared until their classes are linked,
unless the triangle inequality of the Jaccard distance over a pivot proves them too far apart.
Equal texts are one node throughout, so a group of copies costs one comparison; only links leave
a tile, and no bucket is ever held whole in a task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import give_back, single_threaded, stored, text_of, unused
from evidentia.llm.shingles import U, WIDTH, blocks, counted, mixed, shingles, words

SIMILARITY = 0.8
BANDS = 24
ROWS = 5  # coordinates a band; 24 bands of 5 miss a pair of similarity 0.8 once in 14,000
SALT_EVERY = 500  # members compared with one copy of a pivot
TILE = 512  # members of a bucket on one side of a tile


def _unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1]."""
    return ((x >> U(11)).astype(np.float64) + 1.0) * 2.0**-53


def _throw(element: np.ndarray, text: np.ndarray, limit: np.ndarray, texts: int, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(earliest rank, its dart) per text and coordinate, of all darts up to each text's limit."""
    best = np.full(texts * t, np.inf)
    value = np.zeros(texts * t, dtype=np.uint64)
    rank, state = np.zeros(len(element)), element
    seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at, most = text, limit[text]
    while len(state):
        state = mixed(state + U(0x9E3779B97F4A7C15))
        rank = rank - np.log(_unit(state)) / t
        keep = rank <= most
        state, rank, at, most = state[keep], rank[keep], at[keep], most[keep]
        dart = mixed(state ^ U(0xC2B2AE3D27D4EB4F))
        cell = at * t + (dart % U(t)).astype(np.int64)
        np.minimum.at(best, cell, rank)
        seen.append((cell, rank, dart))
    for cell, rank, dart in seen:
        first = rank == best[cell]
        value[cell[first]] = dart[first]
    return best, value


def signatures(element: np.ndarray, first: np.ndarray, t: int) -> np.ndarray:
    """One row of ``t`` dart hashes per text."""
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    limit = (math.log(t) + 4.0) / n
    best, value = _throw(element, text, limit, len(n), t)
    best, value = best.reshape(-1, t), value.reshape(-1, t)
    while True:
        empty = np.flatnonzero(~np.isfinite(best).all(axis=1))
        if not len(empty):
            return value
        limit[empty] *= 2
        mine = np.isin(text, empty)
        place = np.full(len(n), -1)
        place[empty] = np.arange(len(empty))
        again, darts = _throw(element[mine], place[text[mine]], limit[empty], len(empty), t)
        best[empty], value[empty] = again.reshape(-1, t), darts.reshape(-1, t)


def node_of(text: bytes) -> bytes:
    """Texts equal up to white space are one node."""
    return hashlib.md5(b" ".join(text.split())).digest()  # bytes split at space and \t to \r


def _banded(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """key, h1, h2, text -> node, key, h1, h2, one hash per band."""
    single_threaded()
    for batch in batches:
        hashes = np.zeros((batch.num_rows, bands), dtype=np.uint64)
        nodes = [node_of(t.as_py()) for t in batch.column("text").cast(pa.binary())]
        for at, data, offsets in blocks(batch.column("text")):
            word, first, _ = words(data, offsets)
            shingle, first = shingles(word, first)
            mine = signatures(counted(shingle, first), first, bands * rows).reshape(-1, bands, rows)
            band = np.arange(bands, dtype=np.uint64) + U(1)
            for r in range(rows):
                band = mixed(band + mine[:, :, r])
            hashes[at : at + len(mine)] = band
        lists = pa.FixedSizeListArray.from_arrays(pa.array(hashes.ravel().view(np.int64)), bands).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.binary()), *[batch.column(c) for c in ("key", "h1", "h2")], lists], ["node", "key", "h1", "h2", "bands"]
        )
    give_back()


def _bag(text: str) -> np.ndarray:
    (_, data, offsets), *_ = blocks(pa.array([text]))
    word, first, _ = words(data, offsets)
    shingle, first = shingles(word, first)
    return np.sort(counted(shingle, first))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted bags."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (pivot, salt, role): the pivot's text comes first, its members follow."""
    held, bag = None, np.zeros(0, dtype=np.uint64)
    for batch in batches:
        pivots, members, values = [], [], []
        for pivot, salt, role, node, text in zip(*batch.columns):
            name = (pivot.as_py(), salt.as_py())
            if role.as_py() == 0:
                if held != name:
                    held, bag = name, _bag(text.as_py())
            elif held == name:
                pivots.append(name[0])
                members.append(node.as_py())
                values.append(similarity(bag, _bag(text.as_py())))
        yield pa.RecordBatch.from_arrays(
            [pa.array(pivots, pa.binary()), pa.array(members, pa.binary()), pa.array(values, pa.float64())],
            ["a", "b", "sim"],
        )


def _settled(tile: pa.Table, at_least: float) -> pa.Table:
    """Links between members of different classes in one tile of a bucket.

    A pair is looked at in the first band it shares, unless its classes are linked by now or the
    distances to the pivot, or the sizes, rule the similarity out.
    """
    node, label = tile.column("node").to_pylist(), tile.column("class").to_pylist()
    _, once = np.unique(np.array(node, dtype=object), return_index=True)
    tile = tile.take(pa.array(once))
    node, label, own = (tile.column(c).to_pylist() for c in ("node", "class", "own"))
    low, high = tile.column("low")[0].as_py(), tile.column("high")[0].as_py()
    bands, band = np.array(tile.column("bands").to_pylist(), dtype=np.int64), tile.column("band")[0].as_py()
    to_x = np.array([np.nan if x is None else x for x in tile.column("to_x").to_pylist()], dtype=float)
    bags = [_bag(t) for t in tile.column("text").to_pylist()]
    size = np.array([len(b) for b in bags])
    own = np.array(own)
    name, root = {}, list(range(len(node)))
    group = np.array([name.setdefault(c, len(name)) for c in label])

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    found: list[tuple[bytes, bytes]] = []
    # Members of small classes ask, all others of the tile answer.
    counts = np.bincount(group)
    for i in sorted(range(len(node)), key=lambda i: (counts[group[i]], i)):
        ours = find(group[i])
        roots = np.array([find(g) for g in range(len(name))])[group]
        far = np.abs(to_x - to_x[i]) > 1.0 - at_least + 1e-9
        apart = np.minimum(size, size[i]) < at_least * np.maximum(size, size[i]) - 1e-9
        earlier = (bands[:, :band] == bands[i, :band]).any(axis=1)
        mine = (own == high) if own[i] == low else (own == low)
        for j in np.flatnonzero((roots != ours) & mine & ~far & ~apart & ~earlier):
            if find(group[j]) != find(group[i]) and similarity(bags[i], bags[j]) >= at_least:
                found.append((min(node[i], node[j]), max(node[i], node[j])))
                root[find(group[j])] = find(group[i])
    return pa.table({"a": pa.array([f[0] for f in found], pa.binary()), "b": pa.array([f[1] for f in found], pa.binary())})


def located(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, h1, h2): two hashes of key and text tell where a text stands, so that later
    joins need not normalise it again."""
    plain = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    return plain.select("key", "text", *_places(F.col("key"), F.col("text")))


def _places(key: Column, text: Column) -> list[Column]:
    return [F.xxhash64(key, text).alias("h1"), F.xxhash64(text, key, F.lit(1)).alias("h2")]


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h1, h2, text) for the distinct places of ``wanted``; a row given several times counts once.

    Places and texts meet by sorting at every size, so cost grows evenly; the sorted rows need no further
    shuffle where they meet ``wanted`` again.
    """
    places = wanted.select("h1", "h2").distinct().hint("merge")
    found = docs.select("h1", "h2", "text").join(places, ["h1", "h2"], "left_semi")
    return found.groupBy("h1", "h2").agg(F.first("text").alias("text"))


def compared(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, sim) for pairs of nodes (a, b), by exact similarity of whole texts.

    ``docs`` comes from ``located``; ``nodes`` holds the place of one text each. The
    text of b travels once per pair to where a is; a pivot of many pairs gets one copy per
    SALT_EVERY members, so its pairs spread over tasks.
    """
    degree = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    salts = degree.select("a", (F.col("n") / SALT_EVERY).cast("int").alias("most"))
    salted = pairs.join(salts, "a").select(
        F.col("b").alias("node"), F.col("a").alias("pivot"), F.lit(1).alias("role"),
        F.pmod(F.xxhash64("b"), (F.col("most") + 1).cast("bigint")).cast("int").alias("salt"),
    )
    centres = salts.select(
        F.col("a").alias("node"), F.col("a").alias("pivot"), F.lit(0).alias("role"),
        F.explode(F.sequence(F.lit(0), F.col("most"))).alias("salt"),
    )
    wanted = stored(salted.unionByName(centres).join(nodes.select("node", "h1", "h2"), "node"), "near-wanted")
    rows = texts_of(docs, wanted).join(wanted, ["h1", "h2"])
    rows = rows.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "role")
    return rows.select("pivot", "salt", "role", "node", "text").mapInArrow(_compared, "a binary, b binary, sim double")


def components(links: DataFrame) -> DataFrame:
    """(node, class) for all nodes of links (a, b): the smallest node of the connected component.

    Alternates pointing each node's larger neighbours, then its smaller ones, to the smallest
    neighbour, until nothing changes. Each round works on tables in the shared folder.
    """
    edges = stored(links.select("a", "b").where("a <> b").distinct(), "near-edges")
    mark = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Here u > v always: every node has only smaller neighbours.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(small.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = stored(small.where("a <> b").distinct(), "near-edges")
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == tuple(seen):
            break
        mark = tuple(seen)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("class")).unionAll(
        edges.select(F.col("b").alias("node"), F.col("b").alias("class")).distinct()
    )


def near_links(docs: DataFrame, nodes: DataFrame, at_least: float = SIMILARITY) -> DataFrame:
    """All found links (a, b) between different ``nodes`` (node, h1, h2, bands) of ``docs`` (from ``located``)."""
    members = nodes.select("node", F.posexplode("bands").alias("band", "hash")).select(
        F.xxhash64("band", "hash").alias("bucket"), "band", "node"
    )
    draw = lambda seed: F.min(F.struct(F.xxhash64("node", "bucket", F.lit(seed)).alias("h"), F.col("node").alias("p")))
    pivots = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), draw(1).alias("x"), draw(2).alias("y")).where("n > 1")
    pivots = pivots.select("bucket", F.col("x.p").alias("x"), F.col("y.p").alias("y"))
    crowded = stored(members.join(pivots, "bucket"), "near-crowded")
    each = crowded.select("node", F.explode(F.array("x", "y")).alias("p")).where("node <> p")
    pairs = each.select(F.greatest("node", "p").alias("b"), F.least("node", "p").alias("a")).distinct()
    known = stored(compared(docs, nodes, pairs), "near-compared")
    links = known.where(F.col("sim") >= at_least).select("a", "b")

    # Members other than the pivots that lie in several classes: nobody has compared them yet.
    label = components(links)
    others = crowded.where("node <> x AND node <> y").join(label, "node", "left").withColumn("class", F.coalesce("class", "node"))
    open_ = others.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count(F.lit(1)).alias("n"))
    open_ = open_.where("lo <> hi").select("bucket", (F.col("n") / TILE).cast("int").alias("most"))
    to_x = known.select(F.col("a").alias("x"), F.col("b").alias("node"), F.col("sim").alias("to_x"))
    to_x = to_x.unionAll(known.select(F.col("b").alias("x"), F.col("a").alias("node"), F.col("sim").alias("to_x")))
    rest = others.join(open_, "bucket").join(to_x, ["x", "node"], "left").select(
        "node", "bucket", "band", "class", "to_x", "most", F.pmod(F.xxhash64("node"), (F.col("most") + 1).cast("bigint")).cast("int").alias("own")
    )
    rest = stored(rest.join(nodes.select("node", "h1", "h2", "bands"), "node"), "near-open")
    texts = texts_of(docs, rest).join(rest, ["h1", "h2"])
    # Every member meets every tile of its bucket, as a row or as a column of the tile.
    tiles = texts.select(
        "node", "bucket", "band", "class", "to_x", "bands", "text", "own", F.explode(F.sequence(F.lit(0), F.col("most"))).alias("other")
    ).withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    late = tiles.groupBy("bucket", "low", "high").applyInArrow(lambda t: _settled(t, at_least), "a binary, b binary").distinct()
    return stored(links.unionAll(late), "near-links")


def classes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", at_least: float = SIMILARITY,
    bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """One row per row of ``docs``: key, class_id (smallest key of its class), class_size (rows).

    Documents are in one class if a chain of links joins them; a link is a weighted Jaccard
    similarity of word shingles of at least ``at_least``. A text of fewer than five words is one
    shingle of what it has; null and empty texts equal each other. Very long texts are used
    whole. Repeated rows share a class and each comes back. Null keys come after all others and
    are named by null only in a class of nothing else. An empty table gives an empty result.
    Other columns are not read.
    """
    signed, names = _named(docs, key, text, at_least, bands, rows)
    return signed.select("node", F.col("key").alias(key)).join(names, "node").select(key, "class_id", "class_size")


def _named(
    docs: DataFrame, key: str, text: str, at_least: float, bands: int, rows: int
) -> tuple[DataFrame, DataFrame]:
    """Rows as (node, key), and nodes as (node, class_id, class_size, keeper), keeper being the node that stays."""
    kind = docs.schema[key].dataType.simpleString()
    plain = located(docs, key, text)
    signed = stored(
        plain.mapInArrow(lambda b: _banded(b, bands, rows), f"node binary, key {kind}, h1 long, h2 long, bands array<long>"), "near-signatures"
    )
    # One row per node carries its bands on; of its texts the one of the smallest key is compared.
    least = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "h1", "h2")).alias("l")
    nodes = signed.groupBy("node").agg(least, F.first("bands").alias("bands"), F.count(F.lit(1)).alias("n"))
    nodes = stored(nodes.select("node", "bands", "n", F.col("l.none").alias("none"), F.col("l.key").alias("least"), "l.h1", "l.h2"), "near-nodes")
    label = stored(components(near_links(plain, nodes, at_least)), "near-classes")
    named = nodes.drop("bands").join(label, "node", "left").withColumn("class", F.coalesce("class", "node"))
    sized = named.groupBy("class").agg(F.min(F.struct("none", "least", "node", "h1", "h2")).alias("first"), F.sum("n").cast("bigint").alias("class_size"))
    names = named.select("node", "class").join(sized, "class")
    return signed, names.select(
        "node", F.col("first.least").alias("class_id"), "class_size", F.col("first.node").alias("keeper"), "first.h1", "first.h2"
    )


def representatives(
    docs: DataFrame, key: str = "doc_id", text: str = "text", at_least: float = SIMILARITY,
    bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """The rows of ``docs`` that stand for their class: of each class the one of the smallest key.

    All columns come back unchanged; of rows that repeat key and text one stays. The cases of
    ``classes`` hold here too.
    """
    _, names = _named(docs, key, text, at_least, bands, rows)
    h1, h2, nth = (unused(docs.columns, n) for n in ("__h1", "__h2", "__nth"))
    kept = names.where("node = keeper").select(F.col("h1").alias(h1), F.col("h2").alias(h2))
    first, second = _places(F.col(key), text_of(text))
    chosen = docs.withColumns({h1: first, h2: second}).join(kept, [h1, h2])
    one = Window.partitionBy(h1, h2).orderBy(h1)
    return chosen.withColumn(nth, F.row_number().over(one)).where(F.col(nth) == 1).select(docs.columns)
