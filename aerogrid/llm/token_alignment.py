"""Alignment of two tokenizers, and how often their tokens are linked over the corpus.

Both tokenizers end a token at certain places whatever stands around, for example where a word ends and a comma follows.
Texts are cut there; a piece is encoded and aligned once and kept, as most pieces come again.  A first pass over
the documents counts the links (A id, B id) of its pieces.  The distinct pairs get a minimal perfect hash; the tasks' counts
become dense vectors indexed by it, which are added up in two steps.  A second pass aligns the documents
again and looks the counts up.  Pairs beyond `PAIRS` are counted and looked up in further rounds.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerogrid.llm.pair_counts import PerfectHash, build, mixed, shard_of
from aerogrid.session import settle

FOLDER = "/opt/tokenizers"
#: Fixed value: how the byte-level tokenizer cuts texts into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHARD_PAIRS = 65_536  # of one perfect hash, about
PAIRS = 4_000_000  # whose counts a round sends to the tasks, about (12 bytes each)
BLOCK = 1_024  # slots of a row of a dense vector
VECTOR_ROWS = 4_000_000  # counts that go into one task's vector, about
KEPT_BYTES = 80_000_000  # of pieces that a process keeps
PART_BYTES = 4_000_000  # of texts that are cut at once

Built = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def _fan(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows repeated `counts` times: each copy's row, and its number among the row's copies."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _joined(lists: pa.Array, ends: np.ndarray, separator: str) -> pa.Array:
    """The strings of each run that ends at `ends`, with `separator` between them."""
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, lists), separator)


def _kinds() -> np.ndarray:
    """Of each byte: 0 white space, 1 letters, 2 digits, 3 signs, 4 anything else."""
    kinds = np.full(256, 4)
    for c in range(0x21, 0x7F):
        kinds[c] = 1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 3
    kinds[[0x20, *range(0x09, 0x0E)]] = 0
    return kinds


def _cuts(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where both tokenizers always end a token.

    The first array tells it for each two bytes x, y (at 256 x + y).  A's words end where the class of ASCII characters changes, if
    the first is no white space and they are no apostrophe and letter; white space and what follows it stay together.  B never
    merges over two characters that no piece of it has in a row.  The others tell it for a byte after a two-byte character, none of
    which is white space from U+00C0 on: the second for any of these, the third for the letters up to U+00FF.
    """
    kinds = _kinds()
    x, y = kinds[:, None], kinds[None, :]
    cut = (x >= 1) & (x <= 3) & (y <= 3) & (x != y)
    cut[ord("'"), kinds == 1] = False
    after_any, after_letter = kinds == 0, (kinds == 0) | (kinds == 2) | (kinds == 3)
    for piece in pieces:
        for a, b in zip(piece, piece[1:], strict=False):
            a, b = (" " if c == "▁" else c for c in (a, b))
            if ord(b) < 128 and ord(a) < 0x800:
                (cut[ord(a)] if ord(a) < 128 else after_letter if 0xC0 <= ord(a) <= 0xFF else after_any)[ord(b)] = False
    return cut.reshape(-1), after_any & after_letter, after_letter


class Aligner:
    """Both tokenizers and the pieces aligned lately.

    A piece is known by a number; for it there are counts of A's and B's tokens, groups and links, the links, and the groups as text.
    """

    def __init__(self, a_file: str, b_file: str):
        with open(a_file, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        shown = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            shown[rank] = token
        self.a_bytes = pa.array(shown, pa.binary())
        ids = range(self.b.get_piece_size())
        pieces = [self.b.id_to_piece(i) for i in ids]
        self.b_bytes = pa.array([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, pieces, strict=True)], pa.binary())
        self.b_ids = len(pieces)
        self.a_lengths, self.b_lengths = (pc.binary_length(x).to_numpy().astype(np.int64) for x in (self.a_bytes, self.b_bytes))
        self.numerals = pa.array([str(i) for i in range(max(len(shown), len(pieces)))])
        whole = [p for i, p in zip(ids, pieces, strict=True) if not self.b.is_byte(i) and not self.b.is_control(i) and not self.b.is_unknown(i)]
        self.cut, self.after_any, self.after_letter = _cuts(whole)
        self.look_up: tuple[int, np.ndarray, np.ndarray] | None = None
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.counts = np.zeros((4, 0), np.int64)  # A tokens (-1: bytes differ), B tokens, groups, links
        self.first = np.zeros(0, np.int64)
        self.links = np.zeros(0, np.int32)
        self.texts: list[str] = []
        self.held = 0
        self.look_up = None

    def _differ(self, ids: np.ndarray, many: np.ndarray, known: pa.Array, lengths: np.ndarray, pieces: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """Which pieces are not what their tokens' bytes are together."""
        total = np.add.reduceat(np.append(lengths[ids], 0), np.cumsum(many) - many) * (many > 0)
        bad = total != sizes
        if bad.any():
            ids = ids[np.repeat(~bad, many)]
        want = np.frombuffer(b"".join(p for p, other in zip(pieces, bad, strict=True) if not other), np.uint8)
        got = np.frombuffer(known.take(pa.array(ids)).buffers()[2] or b"", np.uint8, len(want))
        if (wrong := np.flatnonzero(got != want)).size:
            same = np.flatnonzero(~bad)
            bad[same[np.searchsorted(np.cumsum(sizes[same]), wrong, "right")]] = True
        return bad

    def learn(self, pieces: list[bytes]) -> None:
        """Align pieces that are not known yet."""
        texts = [p.decode("utf-8", "replace") for p in pieces]
        a_lists = [self.a.encode_ordinary(t) for t in texts]
        # a line break is a token of its own, so B puts nothing before the piece
        b_lists = self.b.encode(["\n" + t for t in texts], num_threads=1)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        a_n, b_n = (np.fromiter(map(len, x), np.int64, len(pieces)) for x in (a_lists, b_lists))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a_lists, a_n), (b_lists, b_n)))
        _, nth = _fan(b_n)
        b, b_n = b[nth >= 2], b_n - 2
        bad = self._differ(a, a_n, self.a_bytes, self.a_lengths, pieces, sizes) | self._differ(b, b_n, self.b_bytes, self.b_lengths, pieces, sizes)
        if bad.any():
            a, b = a[np.repeat(~bad, a_n)], b[np.repeat(~bad, b_n)]
        a_ends, b_ends, ends = np.cumsum(self.a_lengths[a]), np.cumsum(self.b_lengths[b]), np.cumsum(sizes[~bad])
        # tokens overlap in one stretch each, and each stretch between two ends belongs to one A and one B token
        at = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int8)
        at[a_ends] |= 1
        at[b_ends] |= 2
        parts, groups = np.flatnonzero(at), np.flatnonzero(at == 3)
        kind = at[parts]
        a_of, b_of = (np.cumsum(kind & k > 0) - (kind & k > 0) for k in (1, 2))
        links = a[a_of] * self.b_ids + b[b_of]
        group_ends, link_ends = (np.searchsorted(x, ends, "right") for x in (groups, parts))
        counts = np.zeros((4, len(pieces)), np.int64)
        counts[:, ~bad] = a_n[~bad], b_n[~bad], np.diff(group_ends, prepend=0), np.diff(link_ends, prepend=0)
        counts[0, bad] = -1
        sides = [_joined(self.numerals.take(pa.array(ids)), np.searchsorted(x, groups, "right"), ",") for ids, x in ((a, a_ends), (b, b_ends))]
        shown = _joined(pc.binary_join_element_wise(*sides, "|"), group_ends, ";").to_pylist()
        self.held += int(sizes.sum()) + sum(map(len, shown)) + 4 * len(links) + 300 * len(pieces)
        if bad.any():
            places = iter(shown)
            shown = ["" if other else next(places) for other in bad]
        self.texts += shown
        self.first = np.append(self.first, len(self.links) + np.cumsum(counts[3]) - counts[3])
        self.links = np.append(self.links, links.astype(np.int32))
        start = len(self.number)
        self.number.update(zip(pieces, range(start, start + len(pieces)), strict=True))
        self.counts = np.append(self.counts, counts, axis=1)

    def numbers(self, pieces: list[bytes]) -> np.ndarray:
        fresh = [p for p in pieces if p not in self.number]
        if fresh:
            self.learn(fresh)
        return np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))

    def starts(self, data: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Where pieces begin in the bytes of texts that begin at `firsts`."""
        here = np.zeros(len(data), bool)
        here[1:] = self.cut[data[:-1].astype(np.uint16) << 8 | data[1:]]
        second = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)) + 1  # last bytes of two-byte characters
        second = second[second + 1 < len(data)]
        letter = (data[second - 1] == 0xC3) & (data[second] != 0x97) & (data[second] != 0xB7)  # no signs for times and division
        then = data[second + 1]
        here[second[np.where(letter, self.after_letter[then], self.after_any[then])] + 1] = True
        here[firsts] = True
        return np.flatnonzero(here)

    def aligned(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pieces of all texts, and how many pieces each text has (none if its bytes do not come back)."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        some = np.flatnonzero(sizes)
        many = np.zeros(len(texts), np.int64)
        if not len(some):
            return np.zeros(0, np.int64), many
        full = pc.binary_join_element_wise(pa.scalar(""), texts.take(pa.array(some)), " ")
        ends = np.cumsum(sizes[some].astype(np.int64) + 1)
        data = np.frombuffer(full.buffers()[2], np.uint8, int(ends[-1]))
        starts = self.starts(data, np.concatenate([[0], ends[:-1]]))
        offsets = pa.py_buffer(np.append(starts, ends[-1]).astype(np.int32))
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        numbers = self.numbers(pieces.dictionary.to_pylist())[pieces.indices.to_numpy()]
        upto = np.searchsorted(starts, ends)
        many[some] = np.diff(upto, prepend=0)
        bad = self.counts[0, numbers] < 0
        if bad.any():  # whether the whole text's bytes come back decides
            kept = []
            for at, begin, end in zip(some, upto - many[some], upto, strict=True):
                own = numbers[begin:end]
                if bad[begin:end].any():
                    own = self.numbers([b" " + texts[int(at)].as_buffer().to_pybytes()])
                    own = own[self.counts[0, own] >= 0]
                    many[at] = len(own)
                kept.append(own)
            numbers = np.concatenate(kept)
        return numbers, many

    def sums(self, numbers: np.ndarray, counts: LinkCounts) -> tuple[np.ndarray, np.ndarray]:
        """For each number: how many of the piece's links have their B id's highest count, and the links' counts added up."""
        if self.look_up is None or self.look_up[0] != counts.name:
            self.look_up = (counts.name, np.zeros(0, np.int64), np.zeros(0, np.int64))
        name, best, total = self.look_up
        begin, end = len(best), self.counts.shape[1]
        if begin < end:
            n = self.counts[3, begin:end]
            row, _ = _fan(n)
            pairs = self.links[self.first[begin] : self.first[begin] + len(row)]
            found, highest = counts.of(pairs, self.b_ids)
            more = [np.zeros(end - begin, np.int64) for _ in range(2)]
            np.add.at(more[0], row, highest)
            np.add.at(more[1], row, found)
            best, total = np.append(best, more[0]), np.append(total, more[1])
            self.look_up = (name, best, total)
        return best[numbers], total[numbers]


class LinkCounts:
    """Counts of the pairs of one round, by perfect hash, and the highest count of each B id."""

    def __init__(self, name: int, pairs: PerfectHash, counts: np.ndarray, highest: np.ndarray):
        self.name, self.pairs, self.counts, self.highest = name, pairs, counts, highest

    def of(self, pairs: np.ndarray, b_ids: int) -> tuple[np.ndarray, np.ndarray]:
        """Count of each pair, 0 in other rounds, and whether it is its B id's highest."""
        slots = self.pairs.slots(pairs)
        found = np.where(slots >= 0, self.counts[slots] if len(self.counts) else 0, 0)
        return found, (slots >= 0) & (found == self.highest[pairs % b_ids])


@cache
def aligner(a_file: str, b_file: str) -> Aligner:
    """One per process; what it keeps outlives a task."""
    return Aligner(a_file, b_file)


def _parts(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in runs of about PART_BYTES."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PART_BYTES, "right")))
        yield texts.slice(at, end - at)
        at = end


def _count_links(a_file: str, b_file: str):
    """(pair, n) of a task's documents; a pair comes again if the kept pieces were cleared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_file, b_file)
        times = np.zeros(0, np.int64)

        def counted() -> pa.RecordBatch:
            some = np.flatnonzero(times)
            row, nth = _fan(own.counts[3, some])
            pairs, place = np.unique(own.links[own.first[some][row] + nth], return_inverse=True)
            n = np.zeros(len(pairs), np.int64)
            np.add.at(n, place, times[some][row])
            return pa.RecordBatch.from_arrays([pa.array(pairs, pa.int32()), pa.array(n)], ["pair", "n"])

        for batch in batches:
            for texts in _parts(batch["_text"]):
                if own.held > KEPT_BYTES:
                    yield counted()
                    own.clear()
                    times = np.zeros(0, np.int64)
                numbers, _ = own.aligned(texts)
                more = np.bincount(numbers, minlength=len(own.texts))
                more[: len(times)] += times
                times = more
        if len(times):
            yield counted()

    return run


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A perfect hash for each shard; rows come sorted by shard."""

    def built(shard: int, keys: np.ndarray) -> pa.RecordBatch:
        sizes, words, known = build(keys)
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (sizes, words, known))], ["shard", "sizes", "words", "known"])

    at, held = None, []
    for batch in batches:
        shard, pair = batch["shard"].to_numpy(), batch["pair"].to_numpy()
        ends = np.append(np.flatnonzero(shard[1:] != shard[:-1]) + 1, len(shard)) if len(shard) else []
        begin = 0
        for end in ends:
            if held and shard[begin] != at:
                yield built(at, np.concatenate(held))
                held = []
            at = int(shard[begin])
            held.append(pair[begin:end])
            begin = end
    if held:
        yield built(at, np.concatenate(held))


def _dense(pairs: Broadcast, shards: int, rounds: int, number: int):
    """A task's counts as rows (block, v) of one dense vector; each pair of this round must have its slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pairs.value
        vector = np.zeros(-(-len(known.known) // BLOCK) * BLOCK, np.int64)
        for batch in batches:
            pair, n = batch["pair"].to_numpy(), batch["n"].to_numpy()
            own = shard_of(pair, shards) % rounds == number
            slots = known.slots(pair[own])
            if (slots < 0).any():
                raise ValueError("a counted pair has no slot")
            np.add.at(vector, slots, n[own])
        blocks = vector.reshape(-1, BLOCK)
        yield _vector_rows({int(i): blocks[i] for i in np.flatnonzero(blocks.any(axis=1))})

    return run


def _vector_rows(blocks: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([v.tobytes() for v in blocks.values()], pa.binary())], ["block", "v"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the vectors of equal blocks; rows come sorted by block."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, v in zip(batch["block"].to_pylist(), batch["v"], strict=True):
            v = np.frombuffer(v.as_buffer(), np.int64)
            if block in sums:
                sums[block] += v
                continue
            if len(sums) >= 512:
                yield _vector_rows(sums)
                sums = {}
            sums[block] = v.copy()
    if sums:
        yield _vector_rows(sums)


def _tree_sum(vectors: DataFrame) -> DataFrame:
    """Rows (block, v) added up by block, in two steps, so that no task gets the vectors of all tasks."""
    schema = "block int, v binary"
    several = vectors.withColumn("_some", F.pmod(F.spark_partition_id(), F.lit(32)))
    halfway = several.repartition("block", "_some").sortWithinPartitions("block").select("block", "v").mapInArrow(_added, schema)
    return halfway.repartition("block").sortWithinPartitions("block").mapInArrow(_added, schema)


_COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _look_up(a_file: str, b_file: str, counts: Broadcast, id_type: pa.DataType, first: bool, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = aligner(a_file, b_file), counts.value
        for batch in batches:
            done = 0
            for texts in _parts(batch["_text"]):
                if own.held > KEPT_BYTES:
                    own.clear()
                numbers, many = own.aligned(texts)
                ends = np.cumsum(many)
                rows = np.zeros((6, len(texts)), np.int64)
                per_piece = np.vstack([own.counts[:, numbers], *own.sums(numbers, known)])
                some = np.flatnonzero(many)
                if len(some):
                    rows[:, some] = np.add.reduceat(per_piece, (ends - many)[some], axis=1)
                if not first:
                    for i, c in ((4, "n_best"), (5, "count_sum")):
                        rows[i] += batch[c].slice(done, len(texts)).to_numpy()
                used, place = np.unique(numbers, return_inverse=True)
                shown = _joined(pa.array([own.texts[i] for i in used], pa.string()).take(pa.array(place)), ends, ";")
                digests = [hashlib.sha256(s.as_buffer()).hexdigest() if n else "" for s, n in zip(shown, many, strict=True)]
                left = pa.nulls(len(texts), pa.string()) if last else texts
                columns = [batch["_id"].slice(done, len(texts)), left, *map(pa.array, rows), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["_id", "_text", *_COUNTS, "groups_sha256"])
                done += len(texts)

    return run


def _perfect_hash(tables: DataFrame, shards: int, rounds: int, number: int) -> PerfectHash:
    """The hashes of one round's shards, on the driver: about five bytes for each of the round's pairs."""
    rows = tables.where(F.col("shard") % rounds == number).orderBy("shard").toArrow().to_pylist()
    return PerfectHash(shards, [(r["shard"], *(np.frombuffer(r[c], t) for c, t in (("sizes", np.int32), ("words", "<u8"), ("known", np.int32)))) for r in rows])


def _vector(blocks: DataFrame, length: int) -> np.ndarray:
    out = np.zeros(-(-length // BLOCK) * BLOCK, np.int64)
    for row in blocks.toArrow().to_pylist():
        out[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["v"], np.int64)
    return out[:length]


def _with_shard(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(batch["pair"].to_numpy(), shards)), batch["pair"]], ["shard", "pair"])

    return run


def align_tokenizers(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    a_file: str = f"{FOLDER}/byte_bpe_50k.tiktoken",
    b_file: str = f"{FOLDER}/piece_bpe_32k.model",
    shard_pairs: int = SHARD_PAIRS,
    pairs: int = PAIRS,
) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is a byte-level BPE given by its ranks and encodes a space and the text, B a sentencepiece model and encodes the text; strings of
    special tokens are ordinary text to both.  Texts that are null or empty, or whose tokens' bytes are not the space and
    the text, have no tokens: zeros and an empty `groups_sha256`.  Repeated rows are documents of their own and count again; an
    empty table gives an empty result; other columns are ignored.  The files must be at the same path on every executor.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    partial = settle(rows.select("_text").mapInArrow(_count_links(a_file, b_file), "pair int, n long"))
    distinct = settle(partial.select("pair").distinct())
    known = distinct.count()
    shards = known // shard_pairs + 1
    rounds = min(shards, known // pairs + 1)
    dealt = distinct.mapInArrow(_with_shard(shards), "shard int, pair int").repartition("shard").sortWithinPartitions("shard", "pair")
    tables = settle(dealt.mapInArrow(_build, "shard int, sizes binary, words binary, known binary"))
    few = partial.coalesce(partial.count() // VECTOR_ROWS + int(spark.conf.get("spark.sql.shuffle.partitions")))

    sums, highest = [], np.zeros(sentencepiece.SentencePieceProcessor(model_file=b_file).get_piece_size(), np.int64)
    for number in range(rounds):
        found = _perfect_hash(tables, shards, rounds, number)
        sent = spark.sparkContext.broadcast(found)
        sums.append(settle(_tree_sum(few.mapInArrow(_dense(sent, shards, rounds, number), "block int, v binary"))))
        np.maximum.at(highest, found.known % len(highest), _vector(sums[-1], len(found.known)))
        sent.destroy()

    id_type = rows.schema["_id"].dataType
    schema = f"_id {id_type.simpleString()}, _text string, {', '.join(f'{c} long' for c in _COUNTS)}, groups_sha256 string"
    for number, blocks in enumerate(sums):
        found = _perfect_hash(tables, shards, rounds, number)
        counts = _vector(blocks, len(found.known))
        name = int(mixed(counts, number).sum(dtype=np.uint64)) ^ id(counts)
        sent = spark.sparkContext.broadcast(LinkCounts(name, found, counts, highest))
        last = number == rounds - 1
        rows = rows.mapInArrow(_look_up(a_file, b_file, sent, id_type, number == 0, last), schema)
        rows = rows if last else settle(rows)
    return rows.select(F.col("_id").alias(id_col), *_COUNTS, "groups_sha256")
