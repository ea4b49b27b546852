"""Near duplicates by SimHash fingerprints and anchor points.

The anchors are a covering code: 46 of the 64 bits are two words of the binary Golay code's length, and that code is
perfect, so every word has one code word within 3 bits.  A fingerprint's home is the pair of those two code
words; it is copied to every pair of code words within the covering radius plus the threshold (what one
word goes beyond 3 bits and what the other does add up to at most the threshold).  If two
fingerprints differ in so few bits, each is copied to the other's home, so comparing, at every anchor, those
at home with all that are there finds every link.  There are 2^24 anchors whatever the input, so
a bitmap of those that are anybody's home has 2 MB and spares the copies that would meet nobody.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerogrid.llm.common import broadcast_if_small
from aerogrid.llm.graph import components
from aerogrid.session import settle

SHINGLE = 3
SEED = 42
DISTANCE = 2
WORD = 23  # bits of a code word
RADIUS = 3  # the code's covering radius
GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
CHECKS = 11  # degree of the generator, so 12 bits name a code word
BITMAP = 32_768  # bits of one row of Spark's bitmap functions
HOMES, VISITORS = 4_096, 65_536  # rows of an anchor that one comparison takes
PAIRS = 1 << 21  # compared at once in memory


def fingerprint(text: str | None) -> int:
    """64 bits, each set if it is in over half of the shingles' hashes; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    size = min(SHINGLE, len(words))
    starts = np.concatenate([[0], ends])[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)]
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        octets = np.array(hashes[at : at + 8192], "<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t) for t in batch["_text"].to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch["_id"], pa.array(found.view(np.int64))], ["_id", "fp"])


def _remainders(words: np.ndarray) -> np.ndarray:
    """Remainder of each word, as a polynomial over GF(2), by the generator; 0 for code words."""
    rest = words.copy()
    for bit in range(WORD - 1, CHECKS - 1, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - CHECKS), 0)
    return rest


@cache
def code_tables(distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What to flip to get from a word to the code words near it.

    Returns the flips of at most RADIUS + distance bits, ordered by remainder and weight; by how many bits each
    goes beyond the radius; where a remainder's flips begin; and how many of them go at most 0, 1, ... bits beyond.
    """
    flips = [sum(1 << b for b in bits) for weight in range(RADIUS + distance + 1) for bits in combinations(range(WORD), weight)]
    flips = np.array(flips, np.int64)
    beyond = np.maximum(np.bitwise_count(flips).astype(np.int64) - RADIUS, 0)
    rest = _remainders(flips)
    order = np.lexsort((beyond, rest))
    flips, beyond, rest = flips[order], beyond[order], rest[order]
    first = np.searchsorted(rest, np.arange(1 << CHECKS))
    within = np.array([np.bincount(rest[beyond <= e], minlength=1 << CHECKS) for e in range(distance + 1)])
    return flips, beyond, first, within


def _fan(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows repeated `counts` times: each copy's row, and its number among the row's copies."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def anchors(prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (index into prints, anchor number, is its home) of all anchors a fingerprint goes to."""
    flips, beyond, first, within = code_tables(distance)
    low = (prints & np.uint64((1 << WORD) - 1)).astype(np.int64)
    high = (prints >> np.uint64(WORD) & np.uint64((1 << WORD) - 1)).astype(np.int64)
    low_rest, high_rest = _remainders(low), _remainders(high)
    row, nth = _fan(within[distance, low_rest])
    at = first[low_rest[row]] + nth
    used, low_word = beyond[at], low[row] ^ flips[at]
    back, nth = _fan(within[distance - used, high_rest[row]])
    row, used, low_word = row[back], used[back], low_word[back]
    at = first[high_rest[row]] + nth
    high_word = high[row] ^ flips[at]
    return row, low_word >> CHECKS << (WORD - CHECKS) | high_word >> CHECKS, used + beyond[at] == 0


def _visits(distance: int, occupied: Callable[[], np.ndarray] | None):
    """Copies (anchor, fp, home); without `occupied` (a bit per anchor) the homes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(occupied(), np.uint8) if occupied else None
        for batch in batches:
            prints = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            for start in range(0, len(prints), 4096):
                part = prints[start : start + 4096]
                row, anchor, home = anchors(part, distance if occupied else 0)
                if bits is not None:
                    met = np.flatnonzero(bits[anchor >> 3] >> (anchor & 7).astype(np.uint8) & 1)
                    row, anchor, home = row[met], anchor[met], home[met]
                columns = [pa.array(anchor.astype(np.int32)), pa.array(part[row].view(np.int64)), pa.array(home)]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "fp", "home"])

    return run


_COPIES = "anchor int, fp long, home boolean"


def _occupied(prints: DataFrame) -> bytes:
    """One bit for each of the 2^24 anchors, set if a fingerprint is at home there: 2 MB at any input size."""
    number = F.col("anchor").cast("long") + 1
    homes = prints.mapInArrow(_visits(0, None), _COPIES)
    rows = homes.groupBy(F.bitmap_bucket_number(number).alias("_b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("_bits"))
    whole = bytearray(1 << 2 * (WORD - CHECKS) - 3)
    for bucket, bits in rows.collect():
        whole[(bucket - 1) * BITMAP // 8 : bucket * BITMAP // 8] = bits
    return bytes(whole)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of each node that is not the least of its component, of the links a - b."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[i], root[j])
        low = root.copy()
        np.minimum.at(low, i, least)
        np.minimum.at(low, j, least)
        np.minimum.at(low, root[i], least)  # whole trees move at once
        np.minimum.at(low, root[j], least)
        low = low[low]
        if (low == root).all():
            some = np.flatnonzero(root != np.arange(len(root)))
            return nodes[some], nodes[root[some]]
        root = low


def _near(prints: np.ndarray, starts: np.ndarray, homes: np.ndarray, members: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links between the first `homes` and all `members` of each group of rows."""
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    todo = homes * members
    upto = np.cumsum(todo)
    at = 0
    while at < len(todo):
        last = max(at + 1, int(np.searchsorted(upto, upto[at] - todo[at] + PAIRS, "right")))
        for begin in range(0, int(todo[at]) if last == at + 1 else 1, PAIRS):  # only one group alone can be larger
            if last == at + 1:
                nth = np.arange(begin, min(begin + PAIRS, int(todo[at])))
                group = np.full(len(nth), at)
            else:
                group, nth = _fan(todo[at:last])
                group = group + at
            x, y = prints[starts[group] + nth // members[group]], prints[starts[group] + nth % members[group]]
            near = np.flatnonzero((np.bitwise_count(x ^ y) <= distance) & (x != y))
            node, root = forest(x[near], y[near])
            a.append(node)
            b.append(root)
        at = last
    return forest(np.concatenate(a), np.concatenate(b))


def _compare(distance: int):
    """Links at each anchor, as forests; rows come sorted by (anchor, i, j), those at home first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def compared(rows: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
            starts = np.concatenate([[0], ends[:-1]])
            members = ends - starts
            homes = np.add.reduceat(rows["home"].astype(np.int64), starts)
            node, root = _near(rows["fp"], starts, homes, members, distance)
            return pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(root.view(np.int64))], ["a", "b"])

        for batch in batches:
            rows = np.empty(len(batch), [("key", np.int64), ("block", np.int64), ("fp", np.uint64), ("home", bool)])
            i, j = batch["i"].to_numpy(), batch["j"].to_numpy()
            rows["key"], rows["block"] = batch["anchor"].to_numpy(), i.astype(np.int64) << 32 | j
            rows["fp"] = batch["fp"].to_numpy().view(np.uint64)
            rows["home"] = batch["home"].to_numpy(zero_copy_only=False)
            held.append(rows)
            if sum(map(len, held)) < VISITORS:
                continue
            rows = np.concatenate(held)
            ends = np.flatnonzero((rows["key"][1:] != rows["key"][:-1]) | (rows["block"][1:] != rows["block"][:-1])) + 1
            held = [rows]
            if len(ends):  # the last group may go on
                yield compared(rows[: ends[-1]], ends)
                held = [rows[ends[-1] :]]
        if held and sum(map(len, held)):
            rows = np.concatenate(held)
            ends = np.flatnonzero((rows["key"][1:] != rows["key"][:-1]) | (rows["block"][1:] != rows["block"][:-1])) + 1
            yield compared(rows, np.concatenate([ends, [len(rows)]]))

    return run


def _in_blocks(copies: DataFrame, homes: int, visitors: int) -> DataFrame:
    """Rows (anchor, i, j, fp, home): copies at over-full anchors are dealt to blocks (i of those at home, j of all).

    Block i of those at home meets block j of all members in a group of its own, of at most about `homes` and `visitors` rows.
    """
    counts = copies.groupBy("anchor").agg(F.sum(F.col("home").cast("long")).alias("_h"), F.count(F.lit(1)).alias("_n"))
    hot = settle(counts.where((F.col("_h") > homes) | (F.col("_n") > visitors)))
    plain = copies.select("anchor", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp", "home")
    if hot.isEmpty():
        return plain
    number = hot.select("anchor", F.ceil(F.col("_h") / homes).cast("int").alias("_is"), F.ceil(F.col("_n") / visitors).cast("int").alias("_js"))
    number = broadcast_if_small(number)
    there = copies.join(number, "anchor")
    own_i, own_j = (F.pmod(F.xxhash64(F.lit(k), "fp"), F.col(k)).cast("int") for k in ("_is", "_js"))
    numbers = [F.sequence(F.lit(0), F.col(k) - 1) for k in ("_is", "_js")]
    at_home = F.transform(numbers[1], lambda j: F.struct(F.col("own_i").alias("i"), j.alias("j"), F.lit(True).alias("home")))
    others = F.filter(numbers[0], lambda i: (i != F.col("own_i")) | ~F.col("home"))
    visiting = F.transform(others, lambda i: F.struct(i.alias("i"), F.col("own_j").alias("j"), F.lit(False).alias("home")))
    dealt = there.withColumn("own_i", own_i).withColumn("own_j", own_j).withColumn("_to", F.explode(F.when(F.col("home"), F.concat(at_home, visiting)).otherwise(visiting)))
    return plain.join(number, "anchor", "left_anti").unionByName(dealt.select("anchor", "_to.i", "_to.j", "fp", "_to.home"))


def links(prints: DataFrame, distance: int = DISTANCE, homes: int = HOMES, visitors: int = VISITORS) -> DataFrame:
    """Links (a, b) that hold the distinct fingerprints `fp` of `prints` together as pairs within `distance` bits do."""
    shared = prints.sparkSession.sparkContext.broadcast(_occupied(prints))
    copies = settle(prints.mapInArrow(_visits(distance, lambda: shared.value), _COPIES))
    dealt = _in_blocks(copies, homes, visitors).repartition("anchor", "i", "j")
    ordered = dealt.sortWithinPartitions("anchor", "i", "j", F.col("home").desc())
    return ordered.mapInArrow(_compare(distance), "a long, b long").distinct()


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    distance: int = DISTANCE,
    homes: int = HOMES,
    visitors: int = VISITORS,
) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id.

    Words are runs of bytes other than ASCII white space, A-Z in lower case; shingles are three words joined by spaces, repeats
    included; a text of fewer words is one shingle, and null and wordless texts have the fingerprint zero, which is linked
    like any other.  Fingerprints that differ in at most `distance` bits are linked, and `component_id` is the least id
    in reach.  Repeated rows and ids stay rows of their own; null ids are never the least while others are in
    reach; an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()
    signed = settle(rows.mapInArrow(_sign, f"_id {id_type}, fp long"))
    prints = settle(signed.groupBy("fp").agg(F.min("_id").alias("_least")))
    labels = components(links(prints.select("fp"), distance, homes, visitors)).withColumnsRenamed({"v": "fp", "comp": "_comp"})
    linked = labels.join(prints, "fp")
    least = linked.groupBy("_comp").agg(F.min("_least").alias("_of"))
    grouped = linked.join(least, "_comp").select("fp", "_of")
    known = prints.join(broadcast_if_small(settle(grouped)), "fp", "left").select("fp", F.coalesce("_of", "_least").alias("component_id"))
    out = signed.join(broadcast_if_small(settle(known)), "fp")
    return out.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
