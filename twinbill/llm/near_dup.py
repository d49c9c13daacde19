"""MinHash near-duplicates with odd sketches.

1. Every text becomes its set of word shingles, ``bands * rows_per_band``
   MinHash samples of it, the band keys, and an odd sketch: the samples folded
   into a parity bitmap. Texts with equal sets form a class; its smallest id
   stands for it.
2. Classes that share a band key are compared with the smallest class of that
   key, so a group of any size gives one row per member and key, not all pairs.
   The population count of the XOR of two sketches estimates the similarity;
   pairs clearly below the threshold go.
3. The rest is confirmed on full shingle sets, with integers.
4. A band key whose members still lie in several components is looked at again,
   so that a link that does not touch the smallest class is found too. Each
   member outside the key's main component is compared with the whole of that
   component: set sizes, sketches, then full sets, inside the join, so only
   links come out. Both sides are cut into cells of bounded size, so a component
   of any size is spread over tasks. Members outside it are compared with each
   other by band key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import materialize, only
from .text import U, Words, chain, mix, shingles, signed, steps


@dataclass(frozen=True)
class NearDup:
    """``width`` words a shingle; links need ``100 * shared >= percent * union``.

    A pair at similarity s meets in a band with 1 - (1 - s**rows)**bands: with
    56 bands of 7 rows a pair at 0.8 is missed twice in a million. The sketch
    test lets a pair at the threshold pass within ``deviations`` standard
    deviations, five by default.
    """

    width: int = 5
    percent: int = 80
    bands: int = 56
    rows_per_band: int = 7
    sketch_bits: int = 1024
    deviations: float = 5.0

    @property
    def samples(self) -> int:
        return self.bands * self.rows_per_band

    @property
    def most_odd_bits(self) -> int:
        """Largest XOR population count that a pair at the threshold may show."""
        j, k, n = self.percent / 100, self.samples, self.sketch_bits
        unequal = 2 * k * (1 - j)
        fade = exp(-2 * unequal / n)
        odd = n / 2 * (1 - fade)
        by_bits = n / 4 * (1 - fade**2) - unequal * fade**2
        by_samples = 4 * k * j * (1 - j) * fade**2
        spread = sqrt(max(0.0, by_bits) + by_samples)
        return min(n, round(odd + self.deviations * spread))


def _set_digest(found: np.ndarray) -> tuple[int, int]:
    a = np.add.reduce(mix(found ^ U(0x1234567)), dtype=U) + U(len(found))
    b = np.bitwise_xor.reduce(mix(found * U(0x9E3779B97F4A7C15) + U(7)))
    return int(a), int(b)


def _signatures(rule: NearDup):
    random = np.random.default_rng(20240501)
    a = (random.integers(0, 2**31, rule.samples, dtype=np.uint32) * 2 + 1)[:, None]
    b = random.integers(0, 2**32, rule.samples, dtype=np.uint32)[:, None]
    tag = mix(np.arange(rule.samples, dtype=U) + U(99))
    band_tag = mix(np.arange(rule.bands, dtype=U) + U(7777))
    words = rule.sketch_bits // 64

    def samples(found: np.ndarray) -> np.ndarray:
        x = (mix(found) >> U(32)).astype(np.uint32)
        least = np.full(rule.samples, 2**32 - 1, np.uint32)
        for start in range(0, len(x), 2048):
            np.minimum(least, (a * x[None, start : start + 2048] + b).min(axis=1), out=least)
        return least.astype(U)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            text = Words(batch.column("text"))
            n = text.rows
            size = np.zeros(n, np.int64)
            digest = np.zeros((n, 2), U)
            least = np.zeros((n, rule.samples), U)
            for row in range(n):
                found = shingles(text.of(row), rule.width)
                size[row] = len(found)
                if len(found):
                    digest[row] = _set_digest(found)
                    least[row] = samples(found)
            grouped = least.reshape(n, rule.bands, rule.rows_per_band)
            keys = np.broadcast_to(band_tag, (n, rule.bands)).copy()
            for k in range(rule.rows_per_band):
                keys = chain(keys, grouped[:, :, k])
            bit = mix(least ^ tag) % U(rule.sketch_bits)
            flat = bit.astype(np.int64) + rule.sketch_bits * np.arange(n)[:, None]
            odd = np.bincount(flat.ravel(), minlength=n * rule.sketch_bits) & 1
            sketch = np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")
            empty = pa.array(size == 0)
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array(size),
                    pa.array(signed(digest[:, 0].copy()), mask=np.asarray(empty)),
                    pa.array(signed(digest[:, 1].copy())),
                    _lists(signed(keys.reshape(-1)), np.where(size > 0, rule.bands, 0), rule.bands),
                    _lists(signed(sketch), np.full(n, words), words),
                ],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch"],
            )

    return run


def _lists(values: np.ndarray, lengths: np.ndarray, width: int) -> pa.Array:
    kept = values[np.repeat(lengths > 0, width)]
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(kept))


def signatures(docs: DataFrame, rule: NearDup) -> DataFrame:
    return only(docs, "doc_id", "text").mapInArrow(
        _signatures(rule),
        "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch array<long>",
    )


def _full_sets(rule: NearDup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            text = Words(batch.column("text"))
            found = [shingles(text.of(row), rule.width) for row in range(text.rows)]
            lengths = np.array([len(x) for x in found], dtype=np.int32)
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            values = np.concatenate(found) if found else np.empty(0, U)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(values)))],
                names=["id", "items"],
            )

    return run


def _odd_bits(left: str, right: str, rule: NearDup):
    counts = [
        F.bit_count(F.col(left)[k].bitwiseXOR(F.col(right)[k])) for k in range(rule.sketch_bits // 64)
    ]
    total = counts[0]
    for count in counts[1:]:
        total = total + count
    return total


#: Ids that are sent to all executors at most; more are joined by a shuffle of the texts.
BROADCAST_IDS = 2_000_000


def _sets(ids: DataFrame, docs: DataFrame, rule: NearDup) -> DataFrame:
    """``(id, items)`` for the ids, read from the texts once."""
    wanted = ids.select(F.col("id").alias("doc_id")).distinct()
    if wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    return materialize(
        only(docs, "doc_id", "text")
        .join(wanted, "doc_id", "left_semi")
        .mapInArrow(_full_sets(rule), "id long, items array<long>"),
        "sets",
    )


def _similar(left: str, right: str, rule: NearDup):
    shared = F.size(F.array_intersect(left, right))
    return 100 * shared >= rule.percent * (F.size(left) + F.size(right) - shared)


def _confirmed(pairs: DataFrame, sets: DataFrame, rule: NearDup) -> DataFrame:
    """Those ``(u, v)`` whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("u"), F.col("items").alias("left_items"))
    right = sets.select(F.col("id").alias("v"), F.col("items").alias("right_items"))
    return (
        pairs.join(right, "v")
        .join(left, "u")
        .where(_similar("left_items", "right_items", rule))
        .select("u", "v")
        .distinct()
    )


#: Rows that a cell of the comparison with a main component holds on each side, about.
CELL = 2048


def _cells(outside: DataFrame, members: DataFrame) -> DataFrame:
    """Into how many cells each main component's outsiders and members are cut."""
    cuts = lambda name: F.ceil(F.count("*") / CELL).cast("int").alias(name)
    left = outside.groupBy("main").agg(cuts("left_cuts"))
    right = members.groupBy("main").agg(cuts("right_cuts"))
    return materialize(left.join(right, "main"), "cells")


def _in_cells(rows: DataFrame, ident: str, own: str, other: str) -> DataFrame:
    """Each row in its own cell, once for every cell of the other side; cells are dealt evenly to tasks."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        rows.withColumn(f"{own}_cell", F.pmod(F.xxhash64(ident), F.col(f"{own}_cuts")).cast("int"))
        .withColumn(f"{other}_cell", F.explode(F.expr(f"sequence(0, {other}_cuts - 1)")))
        .drop("left_cuts", "right_cuts")
        # A stated number of partitions: cells are small in bytes and heavy in work.
        .repartition(tasks, "main", "left_cell", "right_cell")
    )


def near_duplicates(docs: DataFrame, rule: NearDup | None = None) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) with the component it belongs to.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable over
    links, itself included) and kept (doc_id = component_id). A null, empty or
    blank text has an empty set and is linked with nothing. A null doc_id
    names nothing to link: it gets a null component and is kept. Rows that
    repeat a doc_id count as one document with several texts, so they share a
    component if one of them has words; the id is then kept in each row that
    bears it. Other columns are ignored; an empty table gives no rows.
    """
    rule = rule or NearDup()
    signed_rows = materialize(signatures(docs, rule), "signatures")
    usable = signed_rows.where("doc_id is not null and n_shingles > 0")
    by_set = materialize(usable.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep")), "classes")
    member_of = usable.select("doc_id", "set_a", "set_b").join(by_set, ["set_a", "set_b"]).select("doc_id", "rep")
    # One row per class: the row that gave the smallest id.
    reps = usable.join(
        by_set.select("set_a", "set_b", F.col("rep").alias("doc_id")), ["set_a", "set_b", "doc_id"], "left_semi"
    ).select("doc_id", "n_shingles", "bands", "sketch")

    # Several rows of one class may carry the same smallest id, hence the distinct.
    in_band = reps.select(F.col("doc_id").alias("id"), F.explode("bands").alias("band")).distinct()
    crowded = in_band.groupBy("band").agg(F.min("id").alias("u"), F.max("id").alias("top")).where("u < top")
    met = materialize(
        in_band.join(crowded.select("band", "u"), "band").select("band", "u", F.col("id").alias("v")), "met"
    )
    sketch_u = reps.select(F.col("doc_id").alias("u"), F.col("sketch").alias("su"))
    sketch_v = reps.select(F.col("doc_id").alias("v"), F.col("sketch").alias("sv"))
    close = _odd_bits("su", "sv", rule) <= rule.most_odd_bits
    first = materialize(
        met.where("u < v").select("u", "v").distinct().join(sketch_v, "v").join(sketch_u, "u").where(close).select("u", "v").distinct(),
        "pairs",
    )
    same_id = member_of.where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    first_ids = first.select(F.col("u").alias("id")).union(first.select("v"))
    links = materialize(_confirmed(first, _sets(first_ids, docs, rule), rule), "confirmed")
    label = components(links)

    # Band keys that still hold several components, and the largest of each.
    placed = materialize(
        met.select("band", F.col("v").alias("id"), "u")
        .join(label, "id", "left")
        .select("band", "id", "u", F.coalesce("component", "id").alias("c")),
        "placed",
    )
    parts = placed.groupBy("band", "c").agg(F.count("*").alias("n"))
    mixed = (
        parts.groupBy("band")
        .agg(F.max(F.struct("n", "c"))["c"].alias("main"), F.count("*").alias("k"), F.sum("n").alias("n"))
        .where("k > 1 and n > 2")
    )
    apart = materialize(
        placed.join(mixed.select("band", "main"), "band").where("c <> main"), "apart"
    )
    sketches = reps.select("doc_id", "sketch")

    # Against the main component.
    members = label.unionByName(
        reps.select(F.col("doc_id").alias("id")).join(label, "id", "left_anti").select("id", F.col("id").alias("component"))
    ).join(apart.select(F.col("main").alias("component")).distinct(), "component", "left_semi")
    members = materialize(members, "members")
    outside = apart.select(F.col("id").alias("u"), "main").distinct()
    wanted = members.select("id").union(outside.select("u"))
    sets = _sets(wanted, docs, rule)
    cells = _cells(outside, members.select(F.col("component").alias("main")))
    left = (
        outside.join(cells, "main")
        .join(sketches.select(F.col("doc_id").alias("u"), F.col("sketch").alias("su")), "u")
        .join(sets.select(F.col("id").alias("u"), F.col("items").alias("left_items")), "u")
    )
    right = (
        members.select(F.col("id").alias("v"), F.col("component").alias("main"))
        .join(cells, "main")
        .join(sketches.select(F.col("doc_id").alias("v"), F.col("sketch").alias("sv")), "v")
        .join(sets.select(F.col("id").alias("v"), F.col("items").alias("right_items")), "v")
    )
    low, high = (f(F.size("left_items"), F.size("right_items")) for f in (F.least, F.greatest))
    to_main = (
        _in_cells(left, "u", "left", "right")
        .join(_in_cells(right, "v", "right", "left"), ["main", "left_cell", "right_cell"])
        .where((100 * low >= rule.percent * high) & close & _similar("left_items", "right_items", rule))
        .select("u", "v")
        .distinct()
    )

    # Among those outside it.
    rest = apart.join(sketches.select(F.col("doc_id").alias("id"), F.col("sketch").alias("s")), "id")
    x = rest.select("band", F.col("id").alias("u"), F.col("c").alias("cu"), F.col("s").alias("su"), F.col("u").alias("pivot"))
    y = rest.select("band", F.col("id").alias("v"), F.col("c").alias("cv"), F.col("s").alias("sv"))
    across = materialize(
        x.join(y, "band")
        .where("cu <> cv and u < v and u <> pivot")
        .where(close)
        .select("u", "v")
        .distinct(),
        "across",
    )
    more = materialize(to_main.unionByName(_confirmed(across, sets, rule)), "confirmed")

    label = components(links.unionByName(more).unionByName(same_id))
    return (
        signed_rows.select("doc_id", "n_shingles")
        .join(label.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("component", "doc_id").alias("component_id"),
            (F.col("doc_id").isNull() | (F.col("doc_id") == F.coalesce("component", "doc_id"))).alias("kept"),
        )
    )


def keep_first(docs: DataFrame, rule: NearDup | None = None) -> DataFrame:
    """``docs`` without the documents that follow another of their group.

    One document of each group stays, all its rows if its id is repeated. Rows
    with a null doc_id stay.
    """
    gone = near_duplicates(docs, rule).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
