"""N-gram Jaccard self-join of documents by chosen paths.

Documents with the same set of word shingles are one set. Every set is embedded as one min-hash token per coordinate; sets of similarity s share
each token with probability s. From the root, a run picks 1 / threshold coordinates in expectation and splits the sets into buckets by their
tokens there; a bucket is a path of shared tokens.

- A bucket of at most `bucket_limit` sets is compared by brute force on the signatures. Up to some thousand sets (about 40 ns a pair) that costs a set less
  than the further runs that each split calls for.
- A larger bucket is compared with one of its sets. Jaccard distance obeys the triangle inequality: a set of similarity `cover` or more to that
  centre only has partners of similarity cover + threshold - 1 or more to it. All of those are linked to the centre, so it leaves. The rest is
  split again by the same rule, unless all of it is linked to the centre. After `max_depth` splits all that is left in a bucket is linked to its centre.
- A pair at the threshold becomes a candidate with the probability `recall`, by the runs and the comparison of signatures together. All sets go through
  the runs that one split needs. Sets that stay in buckets above the limit get further runs, as many as the depth that they really reached needs.

Links so far are candidates and a superset. Their connected components are cut into blocks of bounded size, and each pair of blocks is verified
exactly on the shingles of the whole texts. Within a task, pairs are counted and summarised as a spanning forest, never expanded into rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qassay.llm.components import connected_components
from qassay.llm.shared import bit_table, discard, row_keys, settle, text_chunks, whole_groups
from qassay.llm.words import batch_words, mix, shingles

COORDINATES = 128
_rng = np.random.default_rng(7)
_FACTOR = _rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint32) | np.uint32(1)
_FLIP = _rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)
_SIGN = np.uint32(0x9E3779B1)


def met_at(threshold: float, depth: int, alike: float | None = None) -> float:
    """Probability that a pair with the share alike (the threshold) of equal tokens still shares a bucket after depth splits of one run."""
    whole, part = divmod(1 / threshold, 1)
    alike, share = threshold if alike is None else alike, 1.0
    for _ in range(depth):
        share = 1 - (1 - alike * share) ** whole * (1 - alike * share * part)
    return share


def _agreeing(threshold: float) -> list[float]:
    """Probability of each number of equal signature places of a pair at the threshold."""
    return [math.comb(COORDINATES, m) * threshold**m * (1 - threshold) ** (COORDINATES - m) for m in range(COORDINATES + 1)]


def least_slack(threshold: float, recall: float) -> float:
    """How far below the threshold the share of equal places may lie, so that the comparison loses at most a tenth of what recall allows."""
    lost, least = 0.0, 0
    for m, p in enumerate(_agreeing(threshold)):
        lost += p
        if lost > (1 - recall) / 10:
            break
        least = m + 1
    return threshold - least / COORDINATES


def missed(threshold: float, slack: float, depth: int, runs: int) -> float:
    """Probability that a pair at the threshold is no candidate after runs of depth splits. Its signature is the same in every run: too few equal
    places are lost in all of them, and the fewer there are, the less often the pair meets."""
    places = enumerate(_agreeing(threshold))
    return sum(p * ((1 - met_at(threshold, depth, m / COORDINATES)) ** runs if m / COORDINATES >= threshold - slack - 1e-9 else 1) for m, p in places)


def runs_needed(threshold: float, recall: float, slack: float, depth: int) -> int:
    if missed(threshold, slack, 0, 1) > 1 - recall:
        raise ValueError("slack is too small for the recall")
    runs = 1
    while missed(threshold, slack, depth, runs) > 1 - recall:
        runs += 1
    return runs


def chosen_coordinates(nodes: np.ndarray, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(which nodes, their coordinate) for each choice: 1 / threshold coordinates for a node in expectation, fixed by its id."""
    whole, part = divmod(1 / threshold, 1)
    out = []
    for choice in range(int(whole) + 1):
        drawn = mix(nodes + np.uint64((choice + 1) * 0xA0761D6478BD642F % (1 << 64)))
        taken = np.ones(len(nodes), dtype=bool) if choice < whole else (drawn >> np.uint64(40)) < np.uint64(part * (1 << 24))
        at = np.flatnonzero(taken)
        out.append((at, (mix(drawn[at]) % np.uint64(COORDINATES)).astype(np.int64)))
    return out


def root_paths(runs: int, threshold: float) -> list[tuple[int, int, int]]:
    """(salt of the path, coordinate, run) of every first split. Runs from 0 on; a run is the same whatever their number."""
    nodes = mix(np.arange(1, runs + 1, dtype=np.uint64))
    return [(int(mix(nodes[i : i + 1] + np.uint64(c + 1))[0]), int(c), int(i)) for at, coords in chosen_coordinates(nodes, threshold) for i, c in zip(at, coords, strict=True)]


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct shingles of k words; a shorter text with words is one shingle."""
    return np.unique(shingles(words, min(k, len(words)))) if len(words) else np.zeros(0, dtype=np.uint64)


def signatures(docs: DataFrame, k: int, runs: int, threshold: float) -> DataFrame:
    """doc_id, k1, k2, set_id (16 bytes naming the shingle set; null without words), n_grams, sign (two bytes per coordinate), paths (first buckets)."""
    roots = root_paths(runs, threshold)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, chunk in text_chunks(batch.column(3)):
                words, offsets = batch_words(chunk)
                sets = [shingle_set(words[offsets[i] : offsets[i + 1]], k) for i in range(len(chunk))]
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                ids, signs, paths = ([None] * len(chunk) for _ in range(3))
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    low = (flat >> np.uint64(32)).astype(np.uint32)
                    least = np.stack([np.minimum.reduceat((low ^ _FLIP[c]) * _FACTOR[c], starts) for c in range(COORDINATES)], axis=1)
                    named = np.stack([np.add.reduceat(mix(flat ^ np.uint64(s)), starts) for s in (0, 0x5851F42D4C957F2D)], axis=1)
                    short = ((least * _SIGN) >> np.uint32(16)).astype(np.uint16)
                    buckets = np.stack([mix(least[:, c].astype(np.uint64) + np.uint64(salt)) for salt, c, _ in roots], axis=1).view(np.int64)
                    for j, i in enumerate(full):
                        ids[i], signs[i], paths[i] = named[j].tobytes(), short[j].tobytes(), buckets[j]
                keys = [batch.column(c).slice(at, len(chunk)) for c in range(3)]
                made = [pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signs, pa.binary()), pa.array(paths, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*keys, *made], ["doc_id", "k1", "k2", "set_id", "n_grams", "sign", "paths"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(sign, f"doc_id {kind}, k1 long, k2 long, set_id binary, n_grams long, sign binary, paths array<long>")


def _signs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, COORDINATES)


def _forest(linked: np.ndarray) -> np.ndarray:
    """Least index of the connected component of every row of a symmetric boolean matrix."""
    label = np.arange(len(linked))
    while True:
        lower = np.where(linked, label[None, :], len(linked)).min(axis=1, initial=len(linked))
        lower = np.minimum(label, lower)
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def _alike(sign: np.ndarray, least: int, tile: int = 256) -> np.ndarray:
    """Which rows agree in at least `least` places, one coordinate at a time over tiles of rows."""
    columns, out = np.ascontiguousarray(sign.T), np.empty((len(sign), len(sign)), dtype=bool)
    for at in range(0, len(sign), tile):
        equal = np.zeros((min(tile, len(sign) - at), len(sign)), dtype=np.uint8)
        for place in columns:
            equal += place[at : at + tile, None] == place[None, :]
        out[at : at + tile] = equal >= least
    return out


def _compare_small(least_share: float):
    """Rows (bucket, set_no, sign) sorted by bucket -> candidate links of each bucket as a spanning forest."""

    least = math.ceil(COORDINATES * (least_share - 1e-9))

    def link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, ["bucket"]):
            bucket, no = frame["bucket"].to_numpy(), frame["set_no"].to_numpy()
            sign = np.frombuffer(b"".join(frame["sign"]), dtype=np.uint16).reshape(-1, COORDINATES)
            starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            sizes = np.diff(np.append(starts, len(bucket)))
            two = starts[sizes == 2]
            near = (sign[two] == sign[two + 1]).mean(axis=1) >= least_share - 1e-9
            a, b = [no[two[near]]], [no[two[near] + 1]]
            for start, size in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
                own = sign[start : start + size]
                label = _forest(_alike(own, least))
                moved = np.flatnonzero(label != np.arange(size))
                a.append(no[start + label[moved]])
                b.append(no[start + moved])
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return link


def _shares(threshold: float, cut: float):
    """Rows (bucket, set_no, sign, centre, centre_sign) -> bucket, set_no, centre, their share of equal places, and for shares below cut the next buckets."""

    def share_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, sign = batch.column("bucket").to_numpy().astype(np.int64), _signs(batch.column("sign"))
            share = (sign == _signs(batch.column("centre_sign"))).mean(axis=1)
            away = np.flatnonzero(share < cut)
            nodes, row, onward = mix(bucket[away].view(np.uint64)), [away[:0]], [away[:0]]
            for at, coords in chosen_coordinates(nodes, threshold):
                token = sign[away[at], coords].astype(np.uint64)
                row.append(away[at])
                onward.append(mix(nodes[at] + (token << np.uint64(8)) + coords.astype(np.uint64) + np.uint64(1)).view(np.int64))
            row, onward = np.concatenate(row), np.concatenate(onward)
            order = np.argsort(row, kind="stable")
            offsets = np.searchsorted(row[order], np.arange(len(bucket) + 1))
            further = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(onward[order], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), batch.column("set_no"), batch.column("centre"), pa.array(share), further], ["bucket", "set_no", "centre", "share", "onward"])

    return share_of


def _further_paths(threshold: float, runs: int):
    """Rows (set_no, sign, done, need) -> first buckets of the runs from done to before need."""
    roots = root_paths(runs, threshold)

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            no, done, need = (batch.column(c).to_numpy() for c in ("set_no", "done", "need"))
            sign, numbers, buckets = _signs(batch.column("sign")), [no[:0]], [np.zeros(0, dtype=np.int64)]
            for salt, c, run in roots:
                at = np.flatnonzero((done <= run) & (run < need))
                numbers.append(no[at])
                buckets.append(mix(sign[at, c].astype(np.uint64) + np.uint64(salt)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(numbers)), pa.array(np.concatenate(buckets))], ["set_no", "bucket"])

    return further


def _run_links(rows: DataFrame, signs: DataFrame, groups: DataFrame | None, threshold: float, bucket_limit: int, max_depth: int, cover: float, slack: float) -> tuple[list[DataFrame], list[DataFrame], DataFrame, list[DataFrame]]:
    """Candidate links (a, b) of the sets of first buckets (set_no, bucket), the sets (set_no, depth) of buckets at each depth from two on, the signatures of these
    sets, and the tables that the links are read from.

    groups (node, component), where given, are the components of the links found before. Verification compares all sets of a component, so a bucket whose
    sets are all in one is done. So is a bucket whose sets are all linked to its centre. Of the sets linked to the centre only those are split again that
    can have a partner among the others: shares of equal places obey the triangle inequality, and partners share threshold - slack at least.
    """
    found, reached, tables = [], [], []
    cut = cover + slack / 2
    reach = 1 - (threshold - slack) + 1e-9
    wide = cut - reach
    for depth in range(1, max_depth + 1):
        size = [F.count("*").alias("n"), F.min("set_no").alias("centre")]
        if groups is not None:
            rows = rows.join(groups.withColumnRenamed("node", "set_no"), "set_no", "left").withColumn("component", F.coalesce("component", "set_no"))
            size += [F.min("component").alias("least"), F.max("component").alias("most")]
        sized = rows.groupBy("bucket").agg(*size).filter("n > 1" if groups is None else "n > 1 and least < most").select("bucket", "n", "centre")
        members = settle(rows.select("set_no", "bucket").join(sized, "bucket").join(signs, "set_no"), "members")
        small = members.filter(F.col("n") <= bucket_limit).select("bucket", "set_no", "sign")
        small = small.repartition("bucket").sortWithinPartitions("bucket", "set_no")
        found.append(small.mapInPandas(_compare_small(threshold - slack), "a long, b long"))
        tables.append(members)
        large = members.filter(F.col("n") > bucket_limit)
        if large.isEmpty():
            break
        # The centre is one of the sets of its bucket: one signature a bucket joins the others.
        centres = large.filter(F.col("set_no") == F.col("centre")).select("bucket", F.col("sign").alias("centre_sign"))
        shares = large.filter(F.col("set_no") != F.col("centre")).join(centres, "bucket").select("bucket", "set_no", "sign", "centre", "centre_sign")
        shares = settle(shares.mapInArrow(_shares(threshold, cut), "bucket long, set_no long, centre long, share double, onward array<long>"), "shares")
        tables.append(shares)
        found.append(shares.filter(F.lit(True) if depth == max_depth else F.col("share") >= wide).select(F.col("centre").alias("a"), F.col("set_no").alias("b")))
        if depth < max_depth:
            others = shares.filter(F.col("share") < wide).groupBy("bucket").agg(F.max("share").alias("nearest"))
            left = shares.filter(F.col("share") < cut).join(others, "bucket").filter(F.col("share") <= F.col("nearest") + reach)
            rows = settle(left.select("set_no", F.explode("onward").alias("bucket")), "onward")
            reached.append(rows.select("set_no", F.lit(depth + 1).alias("depth")))
            if depth == 1 and groups is None:
                # Only these sets take part in deeper splits and in further runs.
                signs = settle(signs.join(rows.select("set_no").distinct(), "set_no", "left_semi"), "signs")
    return found, reached, signs, tables


def candidate_links(sets: DataFrame, threshold: float, recall: float, bucket_limit: int, max_depth: int, cover: float, slack: float) -> DataFrame:
    """Candidate links (a, b) between sets (set_no, sign, paths), where paths are the first buckets of the runs that one split needs.

    A set takes part in the first runs, up to the number for the deepest bucket that any of its runs reached. Of a pair, the set that reached less
    deep tells how many runs it needs, and both take part in these."""
    needs = [runs_needed(threshold, recall, slack, depth) for depth in range(1, max_depth + 1)]
    signs, rows = sets.select("set_no", "sign"), sets.select("set_no", F.explode("paths").alias("bucket"))
    links, state, groups = None, None, None
    while True:
        found, reached, signs, tables = _run_links(rows, signs, groups, threshold, bucket_limit, max_depth, cover, slack)
        for more in found:
            links = more if links is None else links.unionByName(more)
        if not reached:
            break
        rows = reached[0]
        for more in reached[1:]:
            rows = rows.unionByName(more)
        rows = rows.groupBy("set_no").agg(F.max("depth").alias("depth"))
        if state is None:
            state = rows.withColumn("done", F.lit(needs[0]))
        else:
            rows = state.join(rows.withColumnRenamed("depth", "deeper"), "set_no", "left")
            state = rows.select("set_no", F.greatest("depth", "deeper").alias("depth"), "done")
        state = settle(state.withColumn("need", F.element_at(F.array(*[F.lit(n) for n in needs]), F.col("depth"))), "reached")
        waiting = state.filter("need > done")
        deepest = waiting.agg(F.max("depth")).first()[0]
        if deepest is None:
            break
        groups = settle(connected_components(links), "groups")
        for spent in tables:
            discard(spent)
        links = groups.select(F.col("component").alias("a"), F.col("node").alias("b"))
        # More runs than a set needs do no harm, while each round costs jobs: all waiting sets get those of two splits beyond the deepest.
        ahead = F.lit(needs[min(deepest + 2, max_depth) - 1])
        state = state.withColumn("need", F.when(F.col("need") > F.col("done"), ahead).otherwise(F.col("need")))
        waiting = state.filter("need > done")
        further = _further_paths(threshold, needs[-1])
        rows = settle(waiting.join(signs, "set_no").select("set_no", "sign", "done", "need").mapInArrow(further, "set_no long, bucket long"), "paths")
        state = state.select("set_no", "depth", F.greatest("done", "need").alias("done"))
    return links


def _gram_rows(k: int, shared):
    """Rows (k1, k2, text) -> k1, k2 and the sorted distinct shingles as bytes, for rows whose k1 is in a broadcast bit table."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(shared.value.holds(batch.column("k1").to_numpy().view(np.uint64))))
            for at, chunk in text_chunks(batch.column("text"), 1 << 22):
                words, offsets = batch_words(chunk)
                grams = [shingle_set(words[offsets[i] : offsets[i + 1]], k).tobytes() for i in range(len(chunk))]
                yield batch.slice(at, len(chunk)).set_column(2, "grams", pa.array(grams, pa.binary()))

    return cut


def _shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set: shingles in few sets pair by pair, frequent ones by matrix products."""
    a, b = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(np.unique(a), np.unique(b), assume_unique=True)
    shape = (len(left), len(right))
    if not len(common):
        return np.zeros(shape, dtype=np.int64)

    def cells(sets, flat):
        row, col = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.minimum(np.searchsorted(common, flat), len(common) - 1)
        held = np.flatnonzero(common[col] == flat)
        held = held[np.argsort(col[held], kind="stable")]
        return row[held], col[held], np.bincount(col[held], minlength=len(common))

    (row_a, col_a, in_a), (row_b, col_b, in_b) = cells(left, a), cells(right, b)
    frequent = in_a * in_b > max(16, shape[0] * shape[1] // 200)
    out = np.zeros(shape[0] * shape[1], dtype=np.int64)
    first_b = np.cumsum(in_b) - in_b
    rare = np.flatnonzero(~frequent[col_a])
    many = in_b[col_a[rare]]
    cuts = np.searchsorted(np.cumsum(many), np.arange(0, max(1, many.sum()), 1 << 21), side="left")
    for at, end in zip(cuts, np.append(cuts[1:], len(rare)), strict=True):
        own, n = rare[at:end], many[at:end]
        other = np.repeat(first_b[col_a[own]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        out += np.bincount(np.repeat(row_a[own], n) * shape[1] + row_b[other], minlength=len(out))
    out = out.reshape(shape)
    dense = np.cumsum(frequent) - 1
    sides = [(n, row[frequent[col]], dense[col[frequent[col]]]) for n, row, col in ((shape[0], row_a, col_a), (shape[1], row_b, col_b))]
    strip = 4096
    for at in range(0, int(frequent.sum()), strip):
        parts = []
        for n, row, col in sides:
            first, last = np.searchsorted(col, [at, at + strip])
            m = np.zeros((n, min(strip, int(frequent.sum()) - at)), dtype=np.float32)
            m[row[first:last], col[first:last] - at] = 1
            parts.append(m)
        out += (parts[0] @ parts[1].T).astype(np.int64)
    return out


def _linked(left: list[np.ndarray], right: list[np.ndarray], bound: Fraction) -> np.ndarray:
    """Whether shared / union >= bound, in whole numbers."""
    sizes = [np.array([len(s) for s in side], dtype=np.int64) for side in (left, right)]
    if len(left) * len(right) <= 4:
        shared = np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in right] for x in left], dtype=np.int64)
    else:
        shared = _shared_counts(left, right)
    union = sizes[0][:, None] + sizes[1][None, :] - shared
    return shared * bound.denominator >= union * bound.numerator


def _verify(bound: Fraction):
    """Groups (component, i, j) of shingle rows -> set_no, root (a set linked with it, directly or through others; itself if none), links."""

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, ["component", "i", "j"]):
            starts = np.flatnonzero((frame[["component", "i", "j"]].diff() != 0).any(axis=1).to_numpy())
            out = []
            for start, end in zip(starts, np.append(starts[1:], len(frame)), strict=True):
                rows = frame.iloc[start:end].drop_duplicates("set_no")
                i, j = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
                no, copies, block = (rows[c].to_numpy() for c in ("set_no", "copies", "block"))
                grams = [np.frombuffer(g, dtype=np.uint64) for g in rows["grams"]]
                matrix = np.zeros((len(no), len(no)), dtype=bool)
                if i == j:
                    matrix = _linked(grams, grams, bound)
                    np.fill_diagonal(matrix, False)
                else:
                    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
                    if len(left) and len(right):
                        part = _linked([grams[x] for x in left], [grams[x] for x in right], bound)
                        matrix[np.ix_(left, right)] = part
                        matrix[np.ix_(right, left)] = part.T
                out.append(pd.DataFrame({"set_no": no, "root": no[_forest(matrix)], "links": matrix.astype(np.int64) @ copies}))
            yield pd.concat(out, ignore_index=True)

    return verify


def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, threshold: float = 0.8, recall: float = 0.9999, bucket_limit: int = 4096, max_depth: int = 12, cover: float = 0.6, slack: float | None = None, block_sets: int = 1500, block_grams: int = 1_500_000) -> DataFrame:
    """One row per row of docs: doc_id, k1 and k2 (name of the row), class_id (least doc_id of its group of linked documents), n_links (other rows
    whose shingle sets have a Jaccard similarity of at least threshold, copies included), is_first (it names the first row of its class).

    Words as in `words`; a text of fewer than k words is one shingle. Null texts and texts without words have no shingles and no links, each is
    its own class. Repeated rows are copies of each other; where both id and text repeat, both rows are first. Null ids sort first and
    give a null class_id. Other columns are not looked at; an empty table gives an empty result.
    """
    slack = least_slack(threshold, recall) if slack is None else slack
    own = docs.select(F.col(doc_id).alias("doc_id"), *row_keys(F.col(doc_id), F.col(text)), F.col(text).alias("text"))
    signed = settle(signatures(own, k, runs_needed(threshold, recall, slack, 1), threshold), "signatures")
    place = F.min(F.struct("doc_id", "k1", "k2", "n_grams", "sign", "paths")).alias("p")
    sets = signed.filter(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.count("*").alias("copies"), place)
    sets = sets.select("set_id", "copies", "p.*", F.monotonically_increasing_id().alias("set_no"))
    sets = settle(sets, "sets")

    component = settle(connected_components(candidate_links(sets, threshold, recall, bucket_limit, max_depth, cover, slack)), "candidates")
    named = component.withColumnRenamed("node", "set_no").join(sets.select("set_no", "copies", "k1", "k2", "n_grams"), "set_no")
    blocks = F.ceil(F.greatest(F.count("*") / block_sets, F.sum("n_grams") / block_grams)).cast("int").alias("blocks")
    named = named.join(named.groupBy("component").agg(blocks), "component")
    named = named.withColumn("block", F.pmod(F.xxhash64("set_no"), F.col("blocks")).cast("int"))
    named = settle(named, "named")
    # Texts of sets without a candidate are not shuffled, but for a few that the bit table cannot tell apart.
    wanted = own.sparkSession.sparkContext.broadcast(bit_table(named.select(F.col("k1").alias("hash"))))
    grams = own.select("k1", "k2", "text").mapInArrow(_gram_rows(k, wanted), "k1 long, k2 long, grams binary").join(named, ["k1", "k2"])
    grams = grams.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    grams = grams.select("set_no", "component", "copies", "block", "grams", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    grams = grams.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    verified = settle(grams.mapInPandas(_verify(Fraction(str(threshold))), "set_no long, root long, links long"), "verified")

    links = verified.groupBy("set_no").agg(F.sum("links").alias("links"))
    group = connected_components(verified.select(F.col("set_no").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "set_no")
    info = sets.select("set_id", "set_no", "copies", F.struct("doc_id", "k1", "k2").alias("own"))
    info = info.join(links, "set_no", "left").join(group, "set_no", "left").withColumn("component", F.coalesce("component", "set_no"))
    info = settle(info, "classes")
    info = info.join(info.groupBy("component").agg(F.min("own").alias("first")), "component")
    info = info.select("set_id", "first", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    alone = F.col("first").isNull()
    first = F.when(alone, True).otherwise((F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2")))
    return signed.select("doc_id", "k1", "k2", "set_id").join(info, "set_id", "left").select(
        "doc_id", "k1", "k2", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), first.alias("is_first"),
    )
