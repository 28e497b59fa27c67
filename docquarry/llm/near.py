"""Near duplicates: banded MinHash candidates, odd sketches, full sets, components."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.components import components
from docquarry.llm.store import rows_of, stored
from docquarry.llm.tokens import text_batches
from docquarry.llm.words import Words, mixed, overlap, shingle_set

SALTS = 64
LARGE = 64  # items of a band that take further hubs; smaller bands make at most half as many pairs a row
FEW = 100  # further hubs end when they join less than one of so many items


@dataclass(frozen=True)
class MinHash:
    """``bands`` of ``rows`` minima each; a pair of similarity s shares a band with probability
    1 - (1 - s^rows)^bands, at 0.75 all but 3e-7 with 40 bands of 4 rows. Odd sketches are ``bits``
    parities: the ``whole`` one of all items of sets of at most ``bits``, and for sets of more than half
    as many a ``sketch`` of other samples, the smallest item of each of ``bits`` bins."""

    bands: int = 40
    rows: int = 4
    bits: int = 1024
    seed: int = 7

    def __post_init__(self):
        random = np.random.default_rng(self.seed)
        n = self.bands * self.rows
        object.__setattr__(self, "factors", random.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        object.__setattr__(self, "shifts", random.integers(0, 2**63, n, dtype=np.uint64))

    def minima(self, items: np.ndarray) -> np.ndarray:
        out = np.full(len(self.factors), np.uint64(2**64 - 1))
        for start in range(0, len(items), 1 << 12):
            out = np.minimum(out, (items[None, start:start + (1 << 12)] * self.factors[:, None] + self.shifts[:, None]).min(1))
        return out

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """One 64-bit key per band, different between bands, for each row of minima."""
        total = np.arange(1, self.bands + 1, dtype=np.uint64)
        for column in np.moveaxis(minima.reshape(*minima.shape[:-1], self.bands, self.rows), -1, 0):
            total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + column)
        return total

    def bins(self, items: np.ndarray) -> np.ndarray:
        return (mixed(items + np.uint64(1)) % np.uint64(self.bits)).astype(np.int64)

    def places(self, samples: np.ndarray) -> np.ndarray:
        return (mixed(samples ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(self.bits)).astype(np.int64)

    def sketch(self, items: np.ndarray) -> np.ndarray:
        """Odd sketch of sorted items: bit i is the parity of the samples that hash to i. The sample of
        a bin is its smallest item, so two sets of similarity s have it in common with probability s."""
        _, first = np.unique(self.bins(items), return_index=True)
        odd = np.bincount(self.places(items[first]), minlength=self.bits) & 1
        return np.packbits(odd.astype(np.uint8)).view(np.int64)

    def whole(self, items: np.ndarray) -> np.ndarray:
        """Odd sketch of all items: two sets differ in at most one bit for each item that is not common."""
        odd = np.bincount(self.places(items), minlength=self.bits) & 1
        return np.packbits(odd.astype(np.uint8)).view(np.int64)

    def most_different(self, a: Column, b: Column, similarity: float) -> Column:
        """Sketch bits in which sets of ``a`` and ``b`` items and of at least ``similarity`` may differ.

        A bin whose smallest item is not common changes one sample, or two if the other set has an
        item there, so sets of at most ``bits`` items together differ in at most two bits for each item
        that is not common. For larger sets, samples that differ come as an expectation plus five
        standard deviations; of d samples at most d bits are odd, and on average
        bits / 2 * (1 - exp(-2 d / bits))."""
        total, bins = (a + b).cast("double"), float(self.bits)
        most = F.floor(2 * total * (1 - similarity) / (1 + similarity) + 1e-6)
        filled = bins * (1 - F.exp(-total / ((1 + similarity) * bins)))
        both = 1 - F.exp(-total / (2 * bins))
        samples = filled * (1 - similarity) * (1 + both) + 10 * both * F.sqrt(filled * similarity * (1 - similarity))
        share = (1 - F.exp(-2 * samples / bins)) / 2
        usual = F.least(samples, bins * share + 5 * F.sqrt(bins * share * (1 - share))) + 1
        return F.when(total <= bins, most).otherwise(usual)


SIGNED = "item bigint, n_shingles bigint, digest binary, keys array<bigint>, whole array<bigint>, sketch array<bigint>"


def signatures(texts: DataFrame, scheme: MinHash) -> DataFrame:
    """``texts(item, text)`` -> item, n_shingles, digest of the shingle set, band keys, and the odd sketches that its size has."""

    def run(batches):
        for part, _ in text_batches(batches, values=False):
            words = Words(part.column(1))
            count, digest, lists = [], [], ([], [], [])
            for i in range(part.num_rows):
                found = shingle_set(words.of(i))
                count.append(len(found))
                digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                lists[0].append(scheme.keys(scheme.minima(found)).view(np.int64))
                lists[1].append(scheme.whole(found) if len(found) <= scheme.bits else None)
                lists[2].append(scheme.sketch(found) if len(found) > scheme.bits // 2 else None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count, pa.int64()), pa.array(digest, pa.binary()), *(pa.array(x, pa.list_(pa.int64())) for x in lists)], [c.split()[0] for c in SIGNED.split(", ")])

    return texts.select("item", "text").mapInArrow(run, SIGNED)


def different_bits(a: str, b: str, words: int) -> Column:
    """Population count of the XOR of two sketches."""
    total = F.lit(0)
    for i in range(words):
        total = total + F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i]))
    return total


def may_be_similar(a: str, b: str, scheme: MinHash, similarity: float) -> Column:
    """Whether sizes (n) and odd sketches (whole, else sketch) of two items allow the similarity.

    Sets of it have at most (n + m) * (1 - similarity) / (1 + similarity) items that are not common.
    True where no sketch is in common, as similarities under a half allow."""
    n, m = F.col(f"n{a}"), F.col(f"n{b}")
    sizes = F.least(n, m) >= similarity * F.greatest(n, m)
    words = scheme.bits // 64
    whole = different_bits(f"whole{a}", f"whole{b}", words) <= F.floor((n + m) * (1 - similarity) / (1 + similarity) + 1e-6)
    return sizes & F.coalesce(whole, different_bits(f"sketch{a}", f"sketch{b}", words) <= scheme.most_different(n, m, similarity), F.lit(True))


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, repeated: bool = False) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= ``percent`` * union of their full shingle sets.

    The texts of b go to a's group, which is split by a salt, and stream past the set of a."""
    pairs = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("salt"))
    roles = pairs.select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("item")).distinct().unionAll(pairs.select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("item")))
    wanted = rows_of(texts.select("item", "text"), roles.select("item").distinct(), "item")
    if repeated:
        wanted = wanted.groupBy("item").agg(F.first("text").alias("text"))
    rows = roles.join(wanted, "item").select("a", "salt", "role", "item", "text").repartition("a", "salt").sortWithinPartitions("a", "salt", "role")

    def run(batches):
        group, own = None, None
        for part, _ in text_batches(batches, values=False):
            words = Words(part.column(4))
            out = []
            for i, (a, salt, role, item) in enumerate(zip(*(part.column(k).to_pylist() for k in range(4)))):
                found = shingle_set(words.of(i))
                if role == 0:
                    group, own = (a, salt), found
                elif group == (a, salt):
                    both = overlap(own, found)
                    if 100 * both >= percent * (len(own) + len(found) - both):
                        out.append((a, item))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def near_components(signed: DataFrame, texts: DataFrame, scheme: MinHash, percent: int = 75, repeated: bool = False, rounds: int = 2) -> DataFrame:
    """Components of items whose full shingle sets are similar: node, component.

    ``signed``: a stored result of ``signatures``; rows of one item are equal; ``texts(item,
    text)``, of which rows of an item are equal too if ``repeated``. Candidates share a band and
    have near odd sketches. First each item is compared with the nearest of the hubs of its bands: one
    pair per item however large a group is. A band's hub is the item that meets most others in its
    bands, as the original of many edited copies does. LARGE bands whose items still lie in several
    components take up to ``rounds`` other hubs, as long as these join more than a FEW items. Then, in bands that
    are split still, all pairs across components whose sketches are near are compared, so that a link is
    skipped only where both ends are joined already. No pair within a component is ever written. Rows
    of bands hold sizes and sketches; texts move for candidate pairs only.
    """
    bands = signed.filter("n_shingles > 0").select("item", F.explode("keys").alias("key"))
    band = Window.partitionBy("key")  # all bands of all items are shuffled once
    shared = bands.select("key", "item", F.min("item").over(band).alias("first"), F.max("item").over(band).alias("last"), F.count(F.lit(1)).over(band).alias("size")).filter("first < last")
    met = stored(shared.select("key", "item", "size").distinct())
    degrees = met.groupBy("item").agg(F.sum("size").alias("degree"))
    sketches = rows_of(signed.select("item", F.col("n_shingles").alias("n"), "whole", "sketch"), degrees.select("item"), "item")
    sketches = stored(sketches.groupBy("item").agg(*(F.first(c).alias(c) for c in ("n", "whole", "sketch"))))
    one, two = (sketches.withColumnsRenamed({"item": c, "n": f"n{c}", "whole": f"whole{c}", "sketch": f"sketch{c}"}) for c in ("a", "b"))
    words = scheme.bits // 64
    bits = F.coalesce(different_bits("wholea", "wholeb", words), different_bits("sketcha", "sketchb", words))

    def links(pairs: DataFrame) -> DataFrame:
        """Of hub and item pairs (a, b) the nearest hub of each item, confirmed."""
        near = pairs.distinct().join(one, "a").join(two, "b").filter(may_be_similar("a", "b", scheme, percent / 100))
        best = near.groupBy("b").agg(F.min(F.struct(bits.alias("bits"), "a")).alias("best")).select("best.a", "b")
        return stored(confirmed(stored(best), texts, percent, repeated))

    def merged(joined: DataFrame, more: DataFrame) -> DataFrame:
        """``joined`` with its components linked by ``more``, which only they and single items are contracted for."""
        of = lambda c: joined.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
        ends = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
        roots = stored(components(ends))
        old = joined.join(roots.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        return stored(old.unionAll(roots.join(joined.select("node"), "node", "left_anti").select("node", "component")))

    def split(rows: DataFrame) -> DataFrame:
        """Keys of bands whose items lie in several components, and their sizes."""
        return stored(rows.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("m")).filter("x < y").select("key", "m"))

    def labelled(rows: DataFrame) -> DataFrame:
        """``rows`` with the component of each item."""
        return rows.join(joined.withColumnRenamed("node", "item"), "item", "left").withColumn("label", F.coalesce("component", "item")).drop("component")

    hubs = met.join(degrees, "item").groupBy("key").agg(F.max(F.struct("degree", "item")).alias("hub")).select("key", F.col("hub.item").alias("a"))
    joined = stored(components(links(met.join(hubs, "key").filter("item <> a").select("a", F.col("item").alias("b")))))
    keys = split(labelled(met.select("key", "item")))
    large = keys.filter(F.col("m") > LARGE).select("key")
    keys = keys.filter(F.col("m") <= LARGE).select("key")
    for number in range(rounds):
        if large.isEmpty():
            break
        rows = stored(labelled(met.select("key", "item").join(large, "key")))
        hubs = rows.groupBy("key").agg(F.max(F.struct(F.xxhash64("item", F.lit(number)), "item", "label")).alias("hub")).select("key", F.col("hub.item").alias("a"), F.col("hub.label").alias("own"))
        more = links(rows.join(hubs, "key").filter("label <> own").select("a", F.col("item").alias("b")))
        found = more.count()
        if found:
            joined = merged(joined, more)
            large = split(labelled(rows.select("key", "item"))).select("key")
        if found * FEW < rows.select("item").distinct().count():
            break
    rows = met.select("key", "item").join(keys.unionAll(large), "key")
    own = rows.groupBy("item").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    rows = stored(rows.join(labelled(sketches.join(own, "item")), "item"))
    left, right = (rows.select("key", *(F.col(c).alias(c + s) for c in ("item", "label", "n", "whole", "sketch", "keys"))) for s in ("1", "2"))
    once = F.col("key") == F.array_min(F.array_intersect("keys1", "keys2"))  # a pair comes from one of its bands only
    across = left.join(right, "key").filter((F.col("item1") < F.col("item2")) & (F.col("label1") != F.col("label2")) & may_be_similar("1", "2", scheme, percent / 100) & once)
    pairs = stored(across.select(F.col("item1").alias("a"), F.col("item2").alias("b")))
    if pairs.isEmpty():
        return joined
    return merged(joined, stored(confirmed(pairs, texts, percent, repeated)))


def near_duplicates(documents: DataFrame, percent: int = 75, scheme: MinHash = MinHash()) -> DataFrame:
    """Documents linked by similar sets of five-word shingles.

    ``documents(doc_id, text)`` -> one row per input row: ``doc_id``, ``n_shingles``,
    ``component_id`` (smallest doc_id reachable), ``kept``. Documents link where 100 *
    intersection >= ``percent`` * union, confirmed on full sets. Equal sets are collapsed
    before any pair is looked for, so copies cost one row each.

    A text of fewer than five words is one shingle; NULL, empty and blank texts have none and
    link with nothing. Rows with a NULL doc_id are returned alone and kept. Repeated rows of a
    doc_id share its component. Other columns are ignored.
    """
    texts = documents.select(F.col("doc_id").cast("bigint").alias("item"), F.col("text").cast("string").alias("text"))
    signed = stored(signatures(texts, scheme))
    sets = signed.filter("n_shingles > 0 AND item IS NOT NULL").groupBy("digest").agg(F.min("item").alias("first"))
    members = stored(signed.select("item", "n_shingles", "digest").join(sets, "digest", "left").select("item", "n_shingles", F.when(F.expr("n_shingles > 0 AND item IS NOT NULL"), F.col("first")).alias("first")))
    distinct = members.filter("first IS NOT NULL").select(F.col("first").alias("item")).distinct()
    joined = near_components(stored(signed.join(distinct, "item", "left_semi")), texts.filter("item IS NOT NULL"), scheme, percent)
    links = joined.withColumnRenamed("node", "first")
    out = members.join(links, "first", "left")
    component = F.coalesce("component", "first", "item")
    return out.select(F.col("item").alias("doc_id"), "n_shingles", component.alias("component_id"), F.col("item").eqNullSafe(component).alias("kept"))
