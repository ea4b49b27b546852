"""Near-duplicate join on word shingles by chosen paths.

A document is the set of its five-word shingles; equal sets are one class member.  A MinHash signature
maps each set to tokens (coordinate, value), so that similar sets share tokens as often as shingles.  A run starts
with all sets in one bucket; a bucket chooses 1 / similarity of its coordinates on average and splits its
sets by their values, and so on until the buckets are small; pairs above the similarity keep at least one
bucket in common with a chance that the depth bounds, so the number of runs follows from the wanted recall.
All runs share one signature, so the chances are summed over the signatures a pair can have, and those too
unlike for the comparison by signature count as lost.
Buckets are compared by signature, which leaves candidate groups; inside those, the shingle sets themselves
are compared, in blocks of bounded size, so links are exact.  Links are counted per set; pairs are not emitted.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerogrid.llm.common import broadcast_if_small, packed, tie_order
from aerogrid.llm.graph import components
from aerogrid.session import settle

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.99999
COORDINATES = 64
SMALL = 256  # sets in a bucket that is compared at once
DEPTH = 3  # splits after which a bucket is compared in blocks, whatever its size
BLOCK_SETS, BLOCK_SHINGLES = 512, 500_000  # of a block of sets that one task compares
FLOOR_SHARE = 0.25  # of the loss that the recall allows, what the comparison by signature may take
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(1, 65)], np.uint64)
_ODD = np.array([int.from_bytes(xxhash.xxh64_digest(bytes([i])), "big") | 1 for i in range(COORDINATES)], np.uint64)


class _WordHashes(dict):
    """Hash of each word seen lately; emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` lower-case words (one run if there are fewer words)."""
    words = _WORD.findall((text or "").encode("utf-8", "replace").lower())
    if not words:
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    runs = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        runs += h[i : i + len(runs)] * _POWERS[i]
    runs ^= runs >> np.uint64(29)
    return np.unique(runs * _POWERS[-1])


def signature(found: np.ndarray) -> np.ndarray:
    """Least value of each of the coordinates' hashes over the set."""
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(found), 4096):
        mixed = (found[at : at + 4096, None] * _ODD) >> np.uint64(32)
        np.minimum(least, mixed.min(axis=0), out=least)
    return least.astype(np.uint32).view(np.int32)


def _set_name(found: np.ndarray, text: str | None) -> bytes:
    """128-bit name of the set; texts without words are only equal to themselves."""
    return xxhash.xxh3_128_digest(found.tobytes() if len(found) else b"\0" + (text or "").encode("utf-8", "replace"))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, sizes, signs = [], [], []
        for text in batch["_text"].to_pylist():
            found = shingles(text)
            names.append(_set_name(found, text))
            sizes.append(len(found))
            signs.append(signature(found))
        flat = pa.array(np.concatenate(signs) if signs else np.zeros(0, np.int32))
        sign = pa.ListArray.from_arrays(pa.array(np.arange(len(signs) + 1, dtype=np.int32) * COORDINATES), flat)
        columns = [batch["_id"], batch["_t1"], batch["_t2"], pa.array(names, pa.binary()), pa.array(sizes, pa.int32()), sign]
        yield pa.RecordBatch.from_arrays(columns, ["_id", "_t1", "_t2", "set", "n", "sign"])


def _alike_chances(similarity: float) -> list[float]:
    """Chance of each number of equal coordinates of a pair of the given similarity."""
    return [math.comb(COORDINATES, k) * similarity**k * (1 - similarity) ** (COORDINATES - k) for k in range(COORDINATES + 1)]


def least_alike(recall: float, similarity: float) -> int:
    """Equal coordinates that a pair must have to be a candidate: as many as lose at most FLOOR_SHARE of the allowed loss."""
    lost, chances = 0.0, _alike_chances(similarity)
    for k, chance in enumerate(chances):
        lost += chance
        if lost > FLOOR_SHARE * (1 - recall):
            if k == 0:
                raise ValueError(f"a recall of {recall} at similarity {similarity} needs more than {COORDINATES} coordinates")
            return k
    return COORDINATES


def loss_after(runs: int, recall: float, similarity: float, depth: int) -> float:
    """Chance that a pair of the given similarity is lost, by its signature or since no run brought it together."""
    least = least_alike(recall, similarity)
    more = 1 / similarity - int(1 / similarity)
    lost = 0.0
    for k, chance in enumerate(_alike_chances(similarity)):
        meet = 1.0 if k >= least else 0.0
        for _ in range(depth):
            miss = 1 - k / COORDINATES * meet
            meet = 1 - ((1 - more) * miss ** int(1 / similarity) + more * miss ** (int(1 / similarity) + 1))
        lost += chance * (1 - meet) ** runs
    return lost


def runs_for(recall: float, similarity: float, depth: int) -> int:
    """Runs after which a pair of the given similarity is found with the wanted chance, at the given depth."""
    runs = 1
    while loss_after(runs, recall, similarity, depth) > 1 - recall:
        runs += 1
    return runs


def _children(path: Column, sign: Column, similarity: float) -> Column:
    """The buckets below `path` that a set goes to: 1 / similarity of the coordinates on average."""
    least = int(1 / similarity)
    more = F.pmod(F.xxhash64(path, F.lit(-1)), F.lit(1_000_000)) < F.lit(int((1 / similarity - least) * 1_000_000))
    first = F.pmod(F.xxhash64(path, F.lit(0)), F.lit(COORDINATES)).cast("int")
    step = (F.pmod(F.xxhash64(path, F.lit(1)), F.lit(COORDINATES // 2)) * 2 + 1).cast("int")  # odd: all coordinates differ
    below = []
    for i in range(least + 1):
        at = F.pmod(first + step * i, F.lit(COORDINATES))
        child = F.xxhash64(path, at, F.get(sign, at))
        below.append(child if i < least else F.when(more, child))
    return F.array_compact(F.array(*below))


def _buckets(sets: DataFrame, similarity: float, recall: float, small: int, depth: int) -> DataFrame:
    """Rows (path, set, c): buckets of at least two sets, with their size."""
    runs = runs_for(recall, similarity, depth)
    roots = F.transform(F.sequence(F.lit(1), F.lit(runs)), lambda r: F.xxhash64(F.lit("run"), r))
    state = sets.select("set", "sign", F.explode(roots).alias("path")).select("set", F.explode(_children(F.col("path"), F.col("sign"), similarity)).alias("path"))
    leaves = []
    for level in range(1, depth + 1):
        state = settle(state)
        counts = state.groupBy("path").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        counted = settle(state.join(counts, "path").select("path", "set", "c"))
        if level == depth:
            leaves.append(counted)
            break
        leaves.append(counted.where(F.col("c") <= small))
        large = counted.where(F.col("c") > small)
        if large.isEmpty():
            break
        state = large.join(sets.select("set", "sign"), "set").select("set", F.explode(_children(F.col("path"), F.col("sign"), similarity)).alias("path"))
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return out


def _roots(links: np.ndarray) -> np.ndarray:
    """Least index of each index's component in a symmetric link matrix."""
    root = np.arange(len(links))
    while True:
        low = np.minimum(root, np.where(links, root[None, :], len(links)).min(axis=1, initial=len(links)))
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal keys, from batches sorted by key."""
    held: list[pa.Table] = []
    held_key = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if not len(rows):
            continue
        key = list(zip(*[rows[k].to_pylist() for k in keys], strict=True))
        starts = [0] + [i for i in range(1, len(key)) if key[i] != key[i - 1]] + [len(key)]
        for i, j in zip(starts, starts[1:], strict=False):
            if held and key[i] != held_key:
                yield pa.concat_tables(held)
                held = []
            held_key = key[i]
            held.append(rows.slice(i, j - i))
    if held:
        yield pa.concat_tables(held)


def _pairs_of_blocks(rows: DataFrame, group: str, blocks: Column) -> DataFrame:
    """Copies of each row to the pairs of blocks (bi <= bj) that its own block takes part in."""
    own = F.pmod(F.xxhash64(F.lit("block"), "set"), F.col("_blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("bi"), F.greatest(o, F.col("own")).alias("bj")))
    spread = rows.withColumn("_blocks", blocks.cast("int")).withColumn("own", own).withColumn("_to", F.explode(pairs))
    return spread.select(*rows.columns, "own", "_to.bi", "_to.bj").repartition(group, "bi", "bj").sortWithinPartitions(group, "bi", "bj", "set")


def _allowed(own: np.ndarray, bi: int, bj: int) -> np.ndarray:
    """Which pairs this task counts: those across its two blocks, or all of its single block."""
    return own[:, None] != own[None, :] if bi != bj else np.ones((len(own), len(own)), bool)


def _edges(near: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (index, index) that a task of one or two blocks adds to the links between sets sorted by name.

    The task of a single block ties each set to the least name of its component there, whichever bucket it is.  A
    task of two blocks only ties such components to each other, so a group of m sets in b blocks gives m + b * b edges.
    """
    across = own[:, None] != own[None, :]
    root = _roots(near & ~across)
    if not across.any():
        some = np.flatnonzero(root != np.arange(len(root)))
        return some, root[some]
    i, j = np.nonzero(near & across)
    reps, place = np.unique(root, return_inverse=True)
    tied = np.zeros((len(reps), len(reps)), bool)
    tied[place[i], place[j]] = True
    top = _roots(tied)
    some = np.flatnonzero(top != np.arange(len(top)))
    return reps[some], reps[top[some]]


def _near_by_signature(need: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, ["path", "bi", "bj"]):
            if len(rows) < 2:
                continue
            signs = np.array(rows["sign"].to_pylist(), np.int32).astype(np.uint8)
            alike = np.zeros((len(rows), len(rows)), np.uint8)
            for c in range(COORDINATES):
                alike += signs[:, c, None] == signs[None, :, c]
            near = (alike >= need) & ~np.eye(len(rows), dtype=bool)
            names = rows["set"].combine_chunks()
            yield pa.RecordBatch.from_arrays([names.take(pa.array(x)) for x in _edges(near, rows["own"].to_numpy())], ["a", "b"])

    return run


def common_shingles(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of all intersections of two different sets."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    at = place[column]
    common = np.zeros((len(sets), len(sets)), np.float64)
    width = max(1, (1 << 22) // len(sets))
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    for low in range(0, len(shared), width):
        i, j = np.searchsorted(at, [low, low + width])
        part = np.zeros((len(sets), min(width, len(shared) - low)), np.float32)
        part[owner[i:j], at[i:j] - low] = 1
        common += part @ part.T
    return common


def _links(similarity: float):
    """Rows (set, root, links): numbers of links that the task has counted, and edges, which count none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, ["comp", "bi", "bj"]):
            if len(rows) < 2:
                continue
            sets = [np.frombuffer(b, np.uint64) for b in rows["shingles"].to_pylist()]
            sizes = np.array([len(s) for s in sets], np.float64)
            common = common_shingles(sets)
            near = common >= similarity * (sizes[:, None] + sizes[None, :] - common) - 1e-9
            near &= ~np.eye(len(rows), dtype=bool)
            own = rows["own"].to_numpy()
            counts = (near & _allowed(own, rows["bi"][0].as_py(), rows["bj"][0].as_py())).sum(axis=1)
            some = np.flatnonzero(counts)
            names = rows["set"].combine_chunks()
            a, b = _edges(near, own)
            sets = pa.concat_arrays([names.take(pa.array(some)), names.take(pa.array(a))])
            roots = pa.concat_arrays([pa.nulls(len(some), names.type), names.take(pa.array(b))])
            yield pa.RecordBatch.from_arrays([sets, roots, pa.array(np.concatenate([counts[some], np.zeros(len(a), np.int64)]))], ["set", "root", "links"])

    return run


def _with_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([shingles(t).tobytes() for t in batch["_text"].to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch["set"], batch["comp"], batch["_blocks"], found], ["set", "comp", "_blocks", "shingles"])


def candidate_edges(sets: DataFrame, similarity: float, recall: float, small: int = SMALL, depth: int = DEPTH, block_sets: int = BLOCK_SETS) -> DataFrame:
    """Distinct edges (a, b) between the names of `sets` (set, sign) that a bucket has brought together, and that are alike by signature.

    The number of blocks is a power of two, so blocks of other buckets hold the same sets and have the same least name.
    """
    buckets = _buckets(sets, similarity, recall, small, depth)
    filled = buckets.join(sets.select("set", "sign"), "set")
    blocks = F.pow(F.lit(2), F.ceil(F.log2(F.ceil(F.col("c") / (2 * block_sets)))))
    spread = _pairs_of_blocks(filled.select("path", "set", "c", "sign"), "path", blocks).drop("c")
    return spread.mapInArrow(_near_by_signature(least_alike(recall, similarity)), "a binary, b binary").distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    small: int = SMALL,
    depth: int = DEPTH,
    block_sets: int = BLOCK_SETS,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """One row per document: id, _t1, _t2, class_id, set_id, n_links.

    `set_id` is the least id with the same shingle set, `class_id` the least id of the connected
    component of links, and `n_links` the number of other shingle sets with at least the given Jaccard
    similarity; `_t1` and `_t2` name the text.  Words are lower-case runs of letters, digits and
    non-ASCII characters.  A text of fewer than five words is one shingle; null counts as empty; texts without words have no links
    and are only equal to themselves.  Repeated rows are copies; null ids are never the least while
    others exist; an empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).select(
        "_id", "_text", F.xxhash64("_text").alias("_t1"), F.xxhash64(F.lit(11), "_text").alias("_t2")
    )
    id_type = rows.schema["_id"].dataType.simpleString()
    signed = settle(rows.mapInArrow(_sign, f"_id {id_type}, _t1 long, _t2 long, set binary, n int, sign array<int>"))
    own = F.min(F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_t1", "_t2")).alias("rep")
    reps = settle(signed.groupBy("set").agg(own, F.max("n").alias("n"), F.max("sign").alias("sign")))

    edges = candidate_edges(reps.where("n > 0"), similarity, recall, small, depth, block_sets)
    groups = components(edges).withColumnsRenamed({"v": "set"})

    members = groups.join(reps.select("set", "rep", "n"), "set")
    sizes = members.groupBy("comp").agg(F.count(F.lit(1)).alias("_m"), F.sum("n").alias("_s"))
    blocks = F.greatest(F.ceil(F.col("_m") / block_sets), F.ceil(F.col("_s") / block_shingles)).cast("int")
    members = members.join(sizes, "comp").select("set", "comp", blocks.alias("_blocks"), F.col("rep._id").alias("_rid"), F.col("rep._t1").alias("_t1"), F.col("rep._t2").alias("_t2"))
    members = broadcast_if_small(settle(members))
    texts = rows.join(members, ["_t1", "_t2"]).where(F.col("_id").eqNullSafe(F.col("_rid")))
    texts = texts.dropDuplicates(["set"]).select("set", "comp", "_blocks", "_text")
    in_groups = texts.mapInArrow(_with_shingles, "set binary, comp binary, _blocks int, shingles binary")
    compared = _pairs_of_blocks(in_groups, "comp", F.col("_blocks")).drop("_blocks")
    found = settle(compared.mapInArrow(_links(similarity), "set binary, root binary, links long"))

    links = found.where("root IS NULL").groupBy("set").agg(F.sum("links").alias("links"))
    classes = components(found.where("root IS NOT NULL"), "set", "root").withColumnRenamed("v", "set")
    known = reps.select("set", "rep").join(classes, "set", "left").join(links, "set", "left")
    known = settle(known.select("set", "rep", F.coalesce("comp", "set").alias("comp"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links")))
    heads = known.groupBy("comp").agg(F.min("rep").alias("head"))
    known = known.join(heads, "comp").select("set", F.col("head._id").alias("class_id"), F.col("rep._id").alias("set_id"), "n_links", "comp", "head")
    return signed.select("_id", "_t1", "_t2", "set").join(known, "set").withColumnRenamed("_id", id_col)


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, class_id, set_id, n_links."""
    return near_duplicates(docs, id_col, text_col, **options).select(id_col, "class_id", "set_id", "n_links")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that stay, one of each class: its least id; columns as they were.

    Null texts count as empty and are one class; a null id stays only where no row of the class has one; of rows that repeat
    id and text, the one with the greatest other columns stays; an empty table stays empty; no column name clashes.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    is_head = F.col(id_col).eqNullSafe(F.col("head._id")) & (F.col("_t1") == F.col("head._t1")) & (F.col("_t2") == F.col("head._t2"))
    lost = settle(found.where(~is_head).select(F.col(id_col).alias("_id"), F.col("_t1").alias("_l1"), F.col("_t2").alias("_l2")).distinct())
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own_id = F.col(f"`{id_col}`").alias("_own")
    marked = packed(docs, own_id, F.xxhash64(text).alias("_t1"), F.xxhash64(F.lit(11), text).alias("_t2"))
    same = (F.col("_t1") == F.col("_l1")) & (F.col("_t2") == F.col("_l2")) & F.col("_own").eqNullSafe(F.col("_id"))
    kept = marked.join(broadcast_if_small(lost), same, "left_anti")  # those that go are few, so the others need not be moved
    again = found.groupBy(id_col, "_t1", "_t2").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    if again.isEmpty():
        return kept.select("_row.*")
    # rows that repeat both id and text: one of them stays, told apart by the other columns
    best = F.max_by("_row", tie_order(docs, text_col)).alias("_row")
    return kept.groupBy("_own", "_t1", "_t2").agg(best).select("_row.*")
