"""Hard negatives from vectors in Hilbert-curve order, with zone maps and interval bounds."""

from __future__ import annotations

import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.store import shared_folder, stored
from docquarry.scale import broadcast_if_small, top_k

SCALE = 256
BLOCK_ROWS = 1024
TILE_ROWS = 256
ZONES = 4096  # zone maps that are compared with a tile at once
CURVE_DIMENSIONS, CURVE_BITS = 15, 4
EXACT = 1 << 53
LEAST, MOST = -(1 << 62), 1 << 62
TILES_HELD = 16  # tiles whose best rows a task holds before it hands them on

PACKED = "part int, tile bigint, chunk_ids array<bigint>, categories array<int>, width int, matrix binary, low binary, high binary"
WINDOWS = "tile bigint, places array<int>, windows array<int>, lows array<bigint>, highs array<bigint>"
FOUND = "tile bigint, place int, window int, chunk_id bigint, score bigint"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of coordinates below ``2**bits``; neighbours differ by one step in one coordinate."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        one, below = 1 << b, (1 << b) - 1
        for i in range(n):
            turned = (x[i] & one) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(turned, below, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> b & 1, (1 << b) - 1, 0)
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | x[i] >> b & 1
    return key


def rows_matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    """Vectors as rows of one matrix; shorter ones end in zeros."""
    out = np.zeros((len(column), dimensions), np.int64)
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy()
    if len(values):
        row = np.repeat(np.arange(len(column)), lengths)
        out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer ``a @ b.T``: in float64 where every partial sum stays below 2^53, else in 64-bit integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if a.shape[1] * int(np.abs(a).max()) * int(np.abs(b).max()) < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def interval_bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest product of each row of ``q`` with any vector between ``low`` and ``high``, per dimension."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return product(up, low) + product(down, high), product(up, high) + product(down, low)


def usable_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """``chunk_id``, ``category``, ``vector``: floor(scale * x) of each component. Rows that lack a part of these are left out."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("chunk_id").cast("bigint").alias("chunk_id"), F.col("category").cast("int").alias("category"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("chunk_id").isNotNull() & F.col("category").isNotNull() & F.col("embedding").isNotNull()).filter(finite)
    return rows.select("chunk_id", "category", F.transform("embedding", lambda x: F.floor(x * scale)).alias("vector"))


def spread(rows: DataFrame, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each component over all rows; a task sends one row per dimension."""

    def run(batches):
        n, sums, squares = 0, np.zeros(dimensions), np.zeros(dimensions)
        for batch in batches:
            x = rows_matrix(batch.column(0), dimensions).astype(np.float64)
            n, sums, squares = n + len(x), sums + x.sum(0), squares + (x * x).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimensions)), pa.array(np.full(dimensions, float(n))), pa.array(sums), pa.array(squares)], ["d", "n", "s", "q"])

    got = rows.select("vector").mapInArrow(run, "d bigint, n double, s double, q double").groupBy("d").agg(F.sum("n"), F.sum("s"), F.sum("q")).orderBy("d").collect()
    n, s, q = np.array([tuple(r)[1:] for r in got]).T if got else np.zeros((3, dimensions))  # Spark runs no task on an empty relation
    mean = s / np.maximum(n, 1)
    return mean, np.sqrt(np.maximum(q / np.maximum(n, 1) - mean**2, 1e-9))


def packed(rows: DataFrame, dimensions: int, size: int, mean: np.ndarray, deviation: np.ndarray) -> DataFrame:
    """Rows in Hilbert order as blocks of ``size``: ids ascending, matrix, and least and greatest value per dimension.

    The curve runs over the dimensions that vary most, in cells of half a deviation. Equal places
    are split by id and input split, so a very frequent vector fills many parts."""
    chosen = np.argsort(-deviation, kind="stable")[:CURVE_DIMENSIONS]
    cells = 1 << CURVE_BITS

    def place(batches):
        for batch in batches:
            x = rows_matrix(batch.column(2), dimensions)[:, chosen]
            cell = np.clip((x - mean[chosen]) / deviation[chosen] * 2 + cells / 2, 0, cells - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert_keys(cell, CURVE_BITS))], [*batch.schema.names, "place"])

    def block(batches):
        ids, categories, matrix = [], [], []

        def out(at):
            i, c, m = (np.concatenate(x) for x in (ids, categories, matrix))
            for x, rest in ((ids, i[at:]), (categories, c[at:]), (matrix, m[at:])):
                x[:] = [rest]
            i, c, m = i[:at], c[:at], m[:at]
            order = np.argsort(i, kind="stable")
            i, c, m = i[order], c[order], m[order]
            least, greatest = m.min(0), m.max(0)
            width = next(w for w in (1, 2, 4, 8) if w == 8 or max(-int(least.min(initial=0)), int(greatest.max(initial=0)) + 1) <= 1 << 8 * w - 1)
            one = [[i.tolist()], [c.tolist()], [width], [m.astype(f"<i{width}").tobytes()], [least.astype("<i8").tobytes()], [greatest.astype("<i8").tobytes()]]
            types = (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(one, types)], ["chunk_ids", "categories", "width", "matrix", "low", "high"])

        for batch in batches:
            ids.append(batch.column(0).to_numpy())
            categories.append(batch.column(1).to_numpy())
            matrix.append(rows_matrix(batch.column(2), dimensions))
            while sum(map(len, ids)) >= size:
                yield out(size)
        if sum(map(len, ids)):
            yield out(size)

    placed = rows.mapInArrow(place, "chunk_id bigint, category int, vector array<bigint>, place bigint").withColumn("split", F.spark_partition_id())
    placed = placed.repartitionByRange("place", "chunk_id", "split").sortWithinPartitions("place", "chunk_id").select("chunk_id", "category", "vector")
    blocks = placed.mapInArrow(block, PACKED.split("tile bigint, ")[1])
    return blocks.withColumns({"part": F.spark_partition_id(), "tile": F.monotonically_increasing_id()}).select("part", "tile", "chunk_ids", "categories", "width", "matrix", "low", "high")


def block_files(blocks: DataFrame) -> DataFrame:
    """Blocks as Parquet, one folder per part of the curve, so that parts nobody needs are not opened."""
    spark = blocks.sparkSession
    path = f"{shared_folder(spark)}/docquarry/{uuid.uuid4().hex}"
    blocks.write.partitionBy("part").parquet(path)
    return spark.read.schema(blocks.schema).parquet(path)


def zone_maps(blocks: DataFrame) -> DataFrame:
    """``part`` and up to ZONES of its blocks without their vectors: block, categories, bounds."""
    zone = F.struct(F.col("tile").alias("block"), F.array_sort(F.array_distinct("categories")).alias("categories"), "low", "high")
    rows = blocks.select("part", F.expr(f"(tile & {(1 << 33) - 1}) div {ZONES}").alias("shelf"), zone.alias("zone"))
    return rows.groupBy("part", "shelf").agg(F.collect_list("zone").alias("zones")).drop("shelf")  # at most ZONES


def numbers(buffer: bytes, width: int, rows: int) -> np.ndarray:
    return np.frombuffer(buffer, f"<i{width}").astype(np.int64).reshape(rows, -1)


def needed(windows: DataFrame, tiles: DataFrame, zones: DataFrame, same: bool, nearest: bool = False) -> DataFrame:
    """Pairs (tile, part, block) of which the block may hold a row for one of the tile's windows.

    A block counts if it has a row of the anchor's category (``same``) or of another one and its
    interval meets the window; with ``nearest`` only each window's block of the greatest bound."""
    schema = "tile bigint, part int, block bigint"

    def run(batches):
        for batch in batches:
            out = []
            for tile, places, lows, highs, categories, width, matrix, part, zone in zip(*(c.to_pylist() for c in batch.columns)):
                q = numbers(matrix, width, len(categories))[places]
                mine = np.array(categories)[places]
                low, high = (np.stack([np.frombuffer(z[c], "<i8") for z in zone]) for c in ("low", "high"))
                least, greatest = interval_bounds(q, low, high)
                has = np.zeros(least.shape, bool)
                for category in np.unique(mine):
                    fits = [any((c == category) == same for c in z["categories"]) for z in zone]
                    has[mine == category] = fits
                meets = has & (greatest >= np.array(lows)[:, None]) & (least <= np.array(highs)[:, None])
                if nearest:
                    best = np.where(meets, greatest, LEAST).argmax(1)
                    meets &= np.arange(len(zone)) == best[:, None]
                out += [(tile, part, zone[j]["block"]) for j in np.flatnonzero(meets.any(0))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64()))], ["tile", "part", "block"])

    parts = zones.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0]
    rows = windows.join(tiles.select("tile", "categories", "width", "matrix"), "tile")
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts)))).join(broadcast_if_small(zones), "part")  # every tile meets every zone map
    rows = rows.select("tile", "places", "lows", "highs", "categories", "width", "matrix", "part", "zones")
    return rows.mapInArrow(run, schema).distinct()


def scan(windows: DataFrame, tiles: DataFrame, blocks: DataFrame, pairs: DataFrame, same: bool, k: int) -> DataFrame:
    """The k best rows of each window among the blocks of ``pairs``: FOUND and ``rank_position``.

    Blocks stay in their split; tiles come to them, by broadcast if small. A task keeps the best
    rows per window, so that it sends k of them and not one set per block."""

    def run(batches):
        held = OrderedDict()

        def out(states):
            rows = [(tile, p, w, i, s) for tile, state in states for p, w, best in zip(state["places"], state["windows"], state["best"]) for s, i in ((-x, y) for x, y in best)]
            for start in range(0, len(rows), 10_000):
                columns = zip(*rows[start:start + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["tile", "place", "window", "chunk_id", "score"])

        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                tile = row.column(5)[0].as_py()
                if tile not in held:
                    ids, categories, width, matrix, places, names, lows, highs = (row.column(i)[0].as_py() for i in range(6, 14))
                    held[tile] = {
                        "ids": np.array(ids), "categories": np.array(categories), "q": numbers(matrix, width, len(ids)), "places": places, "windows": names,
                        "lows": np.array(lows), "highs": np.array(highs), "best": [[] for _ in places]}
                    if len(held) > TILES_HELD:
                        yield from out([held.popitem(last=False)])
                held.move_to_end(tile)
                state = held[tile]
                ids, categories = row.column(1).flatten().to_numpy(), row.column(2).flatten().to_numpy()
                width, matrix = row.column(3)[0].as_py(), row.column(4)[0].as_py()
                score = product(state["q"], numbers(matrix, width, len(ids)))
                allowed = (state["categories"][:, None] == categories) == same
                allowed &= state["ids"][:, None] != ids
                p = np.array(state["places"])
                floor = np.array([-b[-1][0] if len(b) == k else LEAST for b in state["best"]])
                mine = score[p]
                hit = allowed[p] & (mine >= np.maximum(state["lows"], floor)[:, None]) & (mine <= state["highs"][:, None])
                for window in np.flatnonzero(hit.any(1)):
                    there = np.flatnonzero(hit[window])
                    values = mine[window, there]
                    if len(there) > k:
                        there = there[values >= np.partition(values, -k)[-k]]
                        values = mine[window, there]
                    state["best"][window] = sorted(state["best"][window] + list(zip((-values).tolist(), ids[there].tolist())))[:k]
        yield from out(held.items())

    parts = [r[0] for r in pairs.select("part").distinct().collect()]  # at most the number of range partitions
    chosen = blocks.filter(F.col("part").isin(parts)) if parts else blocks.limit(0)
    chosen = chosen.select(F.col("tile").alias("block"), *(F.col(c).alias(f"b_{c}") for c in ("chunk_ids", "categories", "width", "matrix")))
    sides = tiles.select("tile", "chunk_ids", "categories", "width", "matrix").join(windows, "tile").select("tile", "chunk_ids", "categories", "width", "matrix", "places", "windows", "lows", "highs")
    rows = chosen.join(broadcast_if_small(pairs.select("block", "tile")), "block").join(broadcast_if_small(stored(sides)), "tile")
    rows = rows.select("block", "b_chunk_ids", "b_categories", "b_width", "b_matrix", "tile", "chunk_ids", "categories", "width", "matrix", "places", "windows", "lows", "highs")
    return top_k(rows.mapInArrow(run, FOUND), ["tile", "place", "window"], [F.desc("score"), F.asc("chunk_id")], k)


def as_windows(rows: DataFrame, low: Column, high: Column) -> DataFrame:
    """Rows (tile, place, window) with their bounds as one row of arrays per tile; a tile has a bounded number of them."""
    one = F.struct("place", "window", low.cast("bigint").alias("low"), high.cast("bigint").alias("high"))
    rows = rows.groupBy("tile").agg(F.array_sort(F.collect_list(one)).alias("w"))
    return rows.select("tile", *(F.col(f"w.{c}").alias(f"{c}s") for c in ("place", "window", "low", "high")))


def hard_negatives(
    vectors: DataFrame,
    anchors: DataFrame,
    positives: int = 5,
    negatives: int = 5,
    low_percent: int = 80,
    high_percent: int = 100,
    scale: int = SCALE,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Negatives of each anchor and positive whose score is a little below the positive's.

    ``vectors(chunk_id, category, embedding)`` are the candidates and ``anchors`` rows of the
    same columns -> ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``,
    ``positive_score``, ``negative_score``. Components become floor(``scale`` * x); a score is the
    integer product with the anchor. Positives are the best ``positives`` other rows of the
    anchor's category, negatives the best ``negatives`` rows of another one with ``low_percent`` *
    positive_score <= 100 * negative_score <= ``high_percent`` * positive_score, each by
    descending score and ascending chunk_id.

    Candidates lie as Parquet blocks in Hilbert-curve order, anchors as tiles in the same order.
    Zone maps hold each block's least and greatest value per dimension; interval arithmetic
    bounds its scores from both sides, and a block is read for a tile only if its bounds meet one
    of the tile's windows. Positives are looked for in each anchor's most promising block
    first, whose fifth score then bounds the rest. How many blocks are left out depends on how well
    the vectors cluster; results do not. A task keeps a running best per window.

    Rows with a NULL or missing chunk_id, category or embedding, or with a NULL or non-finite
    component, take no part. Shorter vectors end in zeros. Rows that repeat a chunk_id are
    candidates each, but never for an anchor of that id; anchors that repeat an id are mined each
    once per distinct row. Scores must fit 64 bits. Other columns are ignored; empty tables give no rows.
    """
    spark = vectors.sparkSession
    candidates = usable_vectors(vectors, scale)
    asked = usable_vectors(anchors, scale).distinct()
    dimensions = max(candidates.agg(F.max(F.size("vector"))).first()[0] or 0, asked.agg(F.max(F.size("vector"))).first()[0] or 0)
    columns = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not dimensions:  # no vectors, or empty ones only, whose scores are all 0
        if candidates.isEmpty() or asked.isEmpty():
            return spark.createDataFrame([], columns)
        dimensions = 1
    mean, deviation = spread(candidates, dimensions)
    blocks = block_files(packed(candidates, dimensions, block_rows, mean, deviation))
    tiles = stored(packed(asked, dimensions, TILE_ROWS, mean, deviation))
    zones = stored(zone_maps(blocks))

    anchor = tiles.select("tile", F.posexplode("chunk_ids").alias("place", "anchor_id")).withColumn("window", F.lit(0))
    everything = stored(as_windows(anchor, F.lit(LEAST), F.lit(MOST)))
    first = scan(everything, tiles, blocks, stored(needed(everything, tiles, zones, True, nearest=True)), True, positives)
    fifth = first.filter(F.col("rank_position") == positives).select("tile", "place", F.col("score").alias("least"))
    bounded = anchor.join(fifth, ["tile", "place"], "left").withColumn("least", F.coalesce("least", F.lit(LEAST)))
    bounded = stored(as_windows(bounded, F.col("least"), F.lit(MOST)))
    near = stored(scan(bounded, tiles, blocks, stored(needed(bounded, tiles, zones, True)), True, positives))

    rows = near.select("tile", "place", F.col("rank_position").alias("window"), F.col("chunk_id").alias("positive_id"), F.col("score").alias("positive_score"))
    low = F.expr(f"-((-{low_percent} * positive_score) - pmod(-{low_percent} * positive_score, 100)) div 100")
    high = F.expr(f"({high_percent} * positive_score - pmod({high_percent} * positive_score, 100)) div 100")
    wanted = stored(as_windows(rows.filter(low <= high), low, high))
    far = scan(wanted, tiles, blocks, stored(needed(wanted, tiles, zones, False)), False, negatives)
    out = far.withColumnsRenamed({"chunk_id": "negative_id", "score": "negative_score"}).join(rows, ["tile", "place", "window"]).join(anchor.drop("window"), ["tile", "place"])
    return out.select("anchor_id", "positive_id", F.col("rank_position").alias("rank"), "negative_id", "positive_score", "negative_score")
