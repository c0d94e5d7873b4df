"""Near-duplicate documents with ProbMinHash.

A document is its weighted set of five-word shingles, the weight being how often one
occurs.  Every shingle draws the arrivals of a Poisson process whose rate is its weight;
each arrival falls into one of ``BANDS * ROWS`` registers, which keep their earliest
one.  A shingle stops as soon as its next arrival is later than all registers.  Two
documents agree in a register with the probability of their probability Jaccard
similarity.  Documents that agree in all registers of a band are candidates; candidate
pairs are verified by the exact similarity of their shingles.

Texts with the same words are one node from the start.  Within a bucket pairs are
tested against a pivot, the same in all bands first, then another for each band.  What
is left, buckets whose nodes are still in several components, is tested in blocks, every
pair across components, without writing the pairs out.  So no link between two texts of
one bucket is lost, and two texts at the threshold share no bucket once in 100,000.
The classes are the connected components of all verified pairs.

Nulls and edges: A-Z are lower-cased; words are runs without ASCII white space.  Texts
without words, null ones included, are one class.  Texts of one to four words are one
shingle.  Rows with a null ``doc_id`` take part; a class of null ids only has no class
id, and its rows stay.  Rows that repeat a ``doc_id`` are one document if their words
agree; else the classes of all their texts are one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocabbridge.llm.blocks import Slice, frugal, mix, ranges, slices, word_hashes, words
from vocabbridge.llm.graph import components
from vocabbridge.llm.ordered import bit_table, may_contain
from vocabbridge.storage import stored

SHINGLE = 5
BANDS, ROWS = 30, 5
THRESHOLD = 0.8
# Nodes of a bucket that one task tests against each other.
BLOCK = 512
_STEP = np.uint64(0x9E3779B97F4A7C15)
# Bits of a shingle's hash; the rest of a sort key is the text's number in the slice.
_BITS = 44


def _mark(x: int) -> np.uint64:
    return np.uint64((x * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) % (1 << 64))


def shingles(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash (sorted within a text) and weight of the distinct shingles of a
    slice, and two 64-bit digests of the words of each text."""
    found = words(part)
    hashes = word_hashes(found)
    first, last = found.by_text[:-1], found.by_text[1:]
    texts, count = len(first), last - first
    place = np.arange(len(hashes)) - np.repeat(first, count)
    digests = []
    for salt in (1, 2):
        each = mix(hashes * _mark(salt) + mix(place.astype(np.uint64) + _mark(salt + 2)))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(each)])
        digests.append(sums[last] - sums[first] + count.astype(np.uint64))
    padded = np.concatenate([hashes, np.zeros(SHINGLE - 1, np.uint64)])
    left = np.repeat(last, count) - np.arange(len(hashes))  # words from here to the text's end
    total = np.zeros(len(hashes), np.uint64)
    for k in range(SHINGLE):
        total += np.where(left > k, mix(padded[k : k + len(hashes)] + _mark(k + 10)), np.uint64(0))
    starts = (left >= SHINGLE) | (place == 0)
    owner = np.repeat(np.arange(texts), count)[starts].astype(np.uint64)
    key = np.sort(owner << np.uint64(_BITS) | mix(total[starts]) >> np.uint64(64 - _BITS))
    fresh = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    weight = np.diff(np.append(fresh, len(key)))
    key = key[fresh]
    owner = (key >> np.uint64(_BITS)).astype(np.int64)
    return owner, key & np.uint64((1 << _BITS) - 1), weight, *digests


def registers(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """The element that arrives first in every register of every text (0: none)."""
    size = BANDS * ROWS
    best = np.full(texts * size, np.inf)
    winner = np.zeros(texts * size, np.uint64)
    seed = mix(element + _mark(99))
    now, number = np.zeros(len(element)), np.zeros(len(element), np.uint64)
    rate = weight.astype(float)
    while len(owner):
        ahead = int(np.clip(65536 // len(owner), 1, 64))
        count = number[:, None] + np.arange(1, ahead + 1, dtype=np.uint64)
        bits = mix(seed[:, None] + count * _STEP)
        wait = -np.log(((bits >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate[:, None]
        time = now[:, None] + np.cumsum(wait, axis=1)
        chosen = mix(bits + _STEP) % np.uint64(size)
        at = (owner[:, None] * size + chosen.astype(np.int64)).ravel()
        flat = time.ravel()
        useful = np.flatnonzero(flat < best[at])
        at, flat = at[useful], flat[useful]
        np.minimum.at(best, at, flat)
        won = flat == best[at]
        winner[at[won]] = element[useful[won] // ahead]
        now, number = time[:, -1], count[:, -1]
        latest = best.reshape(texts, size).max(axis=1)
        alive = now < latest[owner]
        owner, element, seed = owner[alive], element[alive], seed[alive]
        now, number, rate = now[alive], number[alive], rate[alive]
    return winner.reshape(texts, size)


def band_hashes(winner: np.ndarray) -> np.ndarray:
    """One 64-bit hash per text and band."""
    rows = winner.reshape(len(winner), BANDS, ROWS)
    total = np.zeros((len(winner), BANDS), np.uint64)
    for k in range(ROWS):
        total += mix(rows[:, :, k] + _mark(k + 20))
    return mix(total + mix(np.arange(BANDS, dtype=np.uint64) + _mark(50)))


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, d1, d2, bands`` from ``doc_id, text``; no bands below five words."""

    def run(batches):
        for batch in batches:
            for part in slices(batch.column(1)):
                texts = part.last - part.first
                owner, element, weight, d1, d2 = shingles(part)
                bands = band_hashes(registers(owner, element, weight, texts)).view(np.int64)
                long = np.diff(words(part).by_text) >= SHINGLE
                edges = np.concatenate([[0], np.cumsum(long * BANDS)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(bands[long].ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, texts), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), lists],
                    names=["doc_id", "d1", "d2", "bands"],
                )

    return docs.select("doc_id", "text").mapInArrow(frugal(run), "doc_id long, d1 long, d2 long, bands array<long>")


def shingle_sets(docs: DataFrame, bits: DataFrame) -> DataFrame:
    """``node, items, weights`` of the texts that stand for nodes in shared buckets.

    ``items`` are sorted 32-bit hashes.  Which texts are needed is looked up in a bit
    table of fixed size; a few more are harmless.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch.column(1)):
                owner, element, weight, d1, _ = shingles(part)
                small = (element >> np.uint64(_BITS - 32)).astype(np.uint32)
                weight = weight.astype(np.uint32)
                edges = np.searchsorted(owner, np.arange(part.last - part.first + 1))
                runs = list(zip(edges[:-1], edges[1:], strict=True))
                ids = batch.column(0).slice(part.first, part.last - part.first).fill_null(0)
                named = np.asarray(batch.column(2).slice(part.first, part.last - part.first), np.int64) > 0
                node = np.where(named, np.asarray(ids), d1.view(np.int64) | np.int64(-(1 << 63)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(node),
                        pa.array([small[a:b].tobytes() for a, b in runs], pa.binary()),
                        pa.array([b"" if (weight[a:b] == 1).all() else weight[a:b].tobytes() for a, b in runs], pa.binary()),
                    ],
                    names=["node", "items", "weights"],
                )

    needed = may_contain(docs, bits, F.xxhash64("doc_id")).where(F.col("__hit") | F.col("doc_id").isNull())
    named = F.col("doc_id").isNotNull().cast("long").alias("named")
    sets = needed.select("doc_id", "text", named).mapInArrow(frugal(run), "node long, items binary, weights binary")
    return sets


def similarity(items_a, weights_a, items_b, weights_b) -> float:
    """The probability Jaccard similarity of two weighted sets of sorted hashes.

    The sum over common elements of 1 / sum of max(x / x_d, y / y_d); elements with the
    same x_d / y_d share their inner sum.
    """
    a, b = np.frombuffer(items_a, np.uint32), np.frombuffer(items_b, np.uint32)
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if not weights_a and not weights_b:
        common = len(np.intersect1d(a, b))
        return common / (len(a) + len(b) - common)
    x = np.frombuffer(weights_a, np.uint32) if weights_a else np.ones(len(a))
    y = np.frombuffer(weights_b, np.uint32) if weights_b else np.ones(len(b))
    every = np.union1d(a, b)
    left, right = np.zeros(len(every)), np.zeros(len(every))
    np.add.at(left, np.searchsorted(every, a), x)
    np.add.at(right, np.searchsorted(every, b), y)
    both = (left > 0) & (right > 0)
    total = 0.0
    for ratio in np.unique(left[both] / right[both]):
        same = both.copy()
        same[both] = left[both] / right[both] == ratio
        total += float((left[same] / np.maximum(left, right * ratio).sum()).sum())
    return total


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``a, b`` pairs whose similarity is at least the threshold."""

    def run(batches):
        for batch in batches:
            rows = [c.to_pylist() for c in batch.columns]
            keep = [similarity(*row) >= THRESHOLD - 1e-9 for row in zip(*rows[2:], strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def side(name):
        return sets.select(
            F.col("node").alias(name), F.col("items").alias(f"items_{name}"), F.col("weights").alias(f"weights_{name}")
        )

    joined = pairs.join(side("b"), "b").join(side("a"), "a")
    return joined.select("a", "b", "items_a", "weights_a", "items_b", "weights_b").mapInArrow(frugal(run), "a long, b long")


def _pivot_pairs(members: DataFrame, *salt) -> DataFrame:
    """Distinct pairs of each bucket's pivot with the nodes of other components in it."""
    order = F.struct(F.xxhash64(*salt, "node").alias("h"), F.col("node").alias("a"), F.col("comp").alias("pivot_comp"))
    pivots = members.groupBy("key").agg(F.min(order).alias("p"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    pivots = pivots.where("low <> high").select("key", "p.a", "p.pivot_comp")
    return (
        members.join(pivots, "key")
        .where("comp <> pivot_comp")
        .select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
        .distinct()
    )


def _link(table: pa.Table) -> pa.Table:
    """Links that join components, among the sets of one or two blocks of a bucket.

    Overlaps are counted with an inverted index of the sets.  With weights, let m be the
    sum over common elements of the smaller share of its set: the similarity is between
    m / (2 - m) and m, so it is computed only for pairs that this leaves open.  A pair
    that is in one component by now is not looked at, so there are fewer links than sets.
    """
    nodes, comps = table.column("node").to_pylist(), table.column("comp").to_pylist()
    sides = np.asarray(table.column("side"))
    raw, weights = table.column("items").to_pylist(), table.column("weights").to_pylist()
    items = [np.frombuffer(x, np.uint32) for x in raw]
    sizes = np.array([len(x) for x in items])
    plain = np.array([not w for w in weights])
    owner = np.repeat(np.arange(len(items)), sizes)
    flat = np.concatenate(items)
    amount = np.concatenate(
        [np.frombuffer(w, np.uint32) if w else np.ones(n, np.uint32) for w, n in zip(weights, sizes, strict=True)]
    )
    share = amount / np.bincount(owner, amount)[owner]
    borders = np.append(0, np.cumsum(sizes))
    order = np.argsort(flat, kind="stable")
    values, begins, counts = np.unique(flat[order], return_index=True, return_counts=True)
    holders, held = owner[order], share[order]
    numbers = {c: i for i, c in enumerate(dict.fromkeys(comps))}
    comp = np.array([numbers[c] for c in comps])
    links = []
    for u in range(len(items)):
        if (comp == comp[u]).all():
            break
        at = np.searchsorted(values, items[u])
        near = ranges(begins[at], counts[at])
        overlap = np.bincount(holders[near], minlength=len(items))
        maybe = (overlap > 0) & (comp != comp[u]) & ((sides != sides[u]) if sides[0] != sides[-1] else True)
        exact = plain & plain[u]
        sure = exact & (overlap >= (THRESHOLD - 1e-9) * (sizes + sizes[u] - overlap))
        if exact.all():
            maybe &= sure
        else:
            own = np.repeat(share[borders[u] : borders[u + 1]], counts[at])
            common = np.bincount(holders[near], np.minimum(held[near], own), minlength=len(items))
            maybe &= np.where(exact, sure, common >= THRESHOLD - 1e-9)
            sure |= ~exact & (common >= THRESHOLD * (2 - common))
        tested = [*np.flatnonzero(maybe & sure), *np.flatnonzero(maybe & ~sure)]
        for v in tested:
            if comp[v] == comp[u]:
                continue
            if sure[v] or similarity(raw[u], weights[u], raw[v], weights[v]) >= THRESHOLD - 1e-9:
                comp[comp == comp[v]] = comp[u]
                links.append(sorted((nodes[u], nodes[v])))
    columns = list(zip(*links, strict=True)) if links else [[], []]
    return pa.table({"a": pa.array(columns[0], pa.int64()), "b": pa.array(columns[1], pa.int64())})


def _left_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the components that are left in a bucket, all pairs tested in blocks.

    A bucket's nodes are dealt to blocks of about ``BLOCK``; a task tests one block, or
    one block against another.
    """
    state = members.groupBy("key").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")
    )
    own = F.pmod(F.xxhash64("node", "key"), F.col("blocks"))
    open_ = members.join(state.where("low <> high").select("key", "blocks"), "key").withColumn("own", own)
    dealt = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
    tasks = stored(dealt.select("key", low, high, F.col("own").alias("side"), "node", "comp"), "tasks")
    mixed = tasks.groupBy("key", "low", "high").agg(F.min("comp").alias("c"), F.max("comp").alias("d")).where("c <> d")
    left = tasks.join(mixed.select("key", "low", "high"), ["key", "low", "high"]).join(sets, "node")
    ordered = left.select("key", "low", "high", "side", "node", "comp", "items", "weights")
    return ordered.groupBy("key", "low", "high").applyInArrow(_link_sorted, "a long, b long").distinct()


def _link_sorted(table: pa.Table) -> pa.Table:
    return _link(table.sort_by([("side", "ascending"), ("node", "ascending")]))


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, class_id, class_size, kept``.

    ``class_id`` is the smallest id of the class; that document is kept.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sigs = stored(signatures(docs), "signatures")
    # Ids are not negative in practice; a text without one is known by its digest.
    own = F.coalesce(F.min("doc_id"), F.first("d1").bitwiseOR(F.lit(-(1 << 63))))
    nodes = stored(sigs.groupBy("d1", "d2").agg(own.alias("node"), F.first("bands").alias("bands")), "nodes")
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    members = stored(keyed.join(shared, "key").select("key", "node"), "members")

    bits = stored(bit_table(members.select("node").distinct().select(F.xxhash64("node").alias("h")), "h"), "bits")
    sets = stored(shingle_sets(docs, bits), "sets")

    links = comps = None
    for step in (
        lambda m: verified(_pivot_pairs(m, F.lit(0)), sets),
        lambda m: verified(_pivot_pairs(m, F.col("key")), sets),
        lambda m: _left_links(m, sets),
    ):
        if comps is None:
            labelled = members.withColumn("comp", F.col("node"))
        else:
            joined = members.join(comps, "node", "left")
            labelled = stored(joined.select("key", "node", F.coalesce("comp", "node").alias("comp")), "labelled")
        found = stored(step(labelled), "links")
        links = found if links is None else links.unionAll(found)
        comps = stored(components(links), "components")
    grouped = nodes.select("d1", "d2", "node").join(comps, "node", "left").select(
        "d1", "d2", F.coalesce("comp", "node").alias("comp")
    )
    rows = stored(sigs.select("doc_id", "d1", "d2").join(grouped, ["d1", "d2"]).select("doc_id", "comp"), "rows")
    classes = rows.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return rows.join(classes, "comp").select(
        "doc_id", "class_id", "class_size",
        F.coalesce(F.col("doc_id") == F.col("class_id"), F.col("class_id").isNull()).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each class, the one with the smallest id.

    Only rows whose id may be among the dropped ones (a bit table of fixed size says so)
    are shuffled.  Rows without an id stay; rows that repeat an id stay or go together.
    """
    classes = near_classes(docs, doc_id, text)
    dropped = stored(classes.where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct(), "dropped")
    bits = stored(bit_table(dropped.select(F.xxhash64("doc_id").alias("h")), "h"), "bits")
    own = F.col(doc_id).cast("long")
    tagged = may_contain(docs, bits, F.xxhash64(own))
    asked = tagged.where("__hit").select(*docs.columns)
    left = asked.join(dropped.withColumnRenamed("doc_id", "__id"), own == F.col("__id"), "left_anti")
    return tagged.where(~F.col("__hit")).select(*docs.columns).unionAll(left)
