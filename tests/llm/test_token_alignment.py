"""Alignment against whole texts, encoded by the given files and aligned token by token."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from aerogrid.llm.pair_counts import PerfectHash, build, shard_of
from aerogrid.llm.token_alignment import FOLDER, align_tokenizers, aligner

NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
LONG = [
    "x" * 100_000,
    "don't, won't! It's 3'4 " * 5_000,
    "a.b,c;d " * 12_000,
    "\n\t \r\n" * 20_000,
    "中文 字 " * 20_000,
    "é à la carte, naïve cóte " * 4_000,
    "9" * 100_000,
    "(" * 50_000 + ")" * 50_000,
    "\U0001f600" * 25_000,
]
SMALL = ["a▁b", " ", "  ", "\n", " lead", "trail ", "tail\n", "a\n\nb", "a \n  b", "\t tab", "　wide  em", "x\x1cy \x1f z", "<s> </s> <0x41> <|endoftext|>", "ﬁ é Å", "nul\x00c\x01", "I'll 'sup ''s 's", "!'s ?'t", "don'T", "   x", "\x85 y", "q​q", "à\tb é\n\nc"]


def tokenizers():
    a = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{FOLDER}/piece_bpe_32k.model")
    signs = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [i for i in range(256) if i not in signs]
    octet = {chr(i): i for i in signs} | {chr(256 + n): i for n, i in enumerate(others)}
    a_bytes = {i: bytes(octet[c] for c in t) if all(c in octet for c in t) else t.encode() for t, i in a.get_vocab().items()}
    b_bytes = {i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())}
    return a, b, a_bytes, b_bytes


def expected(rows):
    a, b, a_bytes, b_bytes = tokenizers()
    per_doc, counts = [], Counter()
    for _, text in rows:
        ids = ([], [])
        if text:
            ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text))
            full = (" " + text).encode()
            if b"".join(a_bytes[i] for i in ids[0]) != full or b"".join(b_bytes[i] for i in ids[1]) != full:
                ids = ([], [])
        links, groups, i, j, x, y, at = [], [[[], []]], 0, 0, 0, 0, 0
        while i < len(ids[0]) and j < len(ids[1]):
            links.append((ids[0][i], ids[1][j]))
            x_end, y_end = x + len(a_bytes[ids[0][i]]), y + len(b_bytes[ids[1][j]])
            at = min(x_end, y_end)
            if x_end == at:
                groups[-1][0].append(str(ids[0][i]))
                i, x = i + 1, x_end
            if y_end == at:
                groups[-1][1].append(str(ids[1][j]))
                j, y = j + 1, y_end
            if x_end == y_end:
                groups.append([[], []])
        groups.pop()
        counts.update(links)
        per_doc.append((ids, links, groups))
    highest = Counter()
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    out = []
    for (doc_id, _), (ids, links, groups) in zip(rows, per_doc, strict=True):
        shown = ";".join(",".join(g[0]) + "|" + ",".join(g[1]) for g in groups)
        best = sum(counts[p] == highest[p[1]] for p in links)
        digest = hashlib.sha256(shown.encode()).hexdigest() if ids[0] else ""
        out.append((doc_id, len(ids[0]), len(ids[1]), len(groups), len(links), best, sum(counts[p] for p in links), digest))
    return sorted(out, key=repr)


def got(df):
    assert df.columns == NAMES
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("n", [0, 1, 5, 70_000])
def test_perfect_hash_is_minimal_and_verified(n):
    keys = np.array(random.Random(n).sample(range(1 << 31), n), np.int32)
    shards = shard_of(keys, 3)
    whole = PerfectHash(3, [(s, *build(keys[shards == s])) for s in range(3)])
    assert sorted(whole.slots(keys)) == list(range(n))
    assert (whole.known[whole.slots(keys)] == keys).all()
    others = np.setdiff1d(np.arange(5_000, dtype=np.int32), keys)
    assert (whole.slots(others) == -1).all()
    some = PerfectHash(3, [(1, *build(keys[shards == 1]))])
    assert ((some.slots(keys) >= 0) == (shards == 1)).all()


@pytest.mark.parametrize("options", [{}, {"shard_pairs": 100, "pairs": 2_000}], ids=["one round", "many rounds"])
def test_whole_table_equals_brute_force(spark, sf_dir, options):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    if options:
        docs = docs.where("length(text) < 400")
    assert got(align_tokenizers(docs, **options)) == expected([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_odd_and_long_texts(spark, odd):
    more = [(100 + i, t) for i, t in enumerate(SMALL + LONG)] + [(200, "plain words, twice. " + "x" * 300)] * 2
    rows = odd.select("doc_id", "text", "_id", "kept").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    assert got(align_tokenizers(rows)) == expected([(r.doc_id, r.text) for r in rows.collect()])


def test_pieces_put_together_are_the_whole_text(spark):
    """Random texts of characters where cuts matter, each cut and whole."""
    a, b, *_ = tokenizers()
    own = aligner(f"{FOLDER}/byte_bpe_50k.tiktoken", f"{FOLDER}/piece_bpe_32k.model")
    rng = random.Random(11)
    parts = ["'", "s", "ll", "T", " ", "  ", "\n", "\t", ".", ",", "!!", "1", "23", "é", "ß", "а", "中", " ", "́", "_", "the", "ing", "x", "\r\n", "(", "://", "-", "\x1c", " "]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randrange(1, 14)))
        data = (" " + text).encode()
        starts = own.starts(np.frombuffer(data, np.uint8), np.array([0]))
        pieces = [data[i:j].decode() for i, j in zip(starts, [*starts[1:], len(data)], strict=True)]
        assert [i for p in pieces for i in a.encode(p, add_special_tokens=False).ids] == a.encode(" " + text, add_special_tokens=False).ids, text
        assert [i for p in pieces for i in own.a.encode_ordinary(p)] == a.encode(" " + text, add_special_tokens=False).ids, text
        assert [i for p in pieces for i in b.encode("\n" + p)[2:]] == b.encode(text), text


def test_kept_pieces_are_cleared_without_loss(spark, sf_dir, monkeypatch):
    from aerogrid.llm import token_alignment

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 1500").coalesce(1)
    texts = docs.select("text").toArrow()["text"].combine_chunks()
    own = token_alignment.aligner(f"{FOLDER}/byte_bpe_50k.tiktoken", f"{FOLDER}/piece_bpe_32k.model")
    monkeypatch.setattr(token_alignment, "PART_BYTES", 5_000)
    totals = []
    for kept in (80_000_000, 20_000):
        monkeypatch.setattr(token_alignment, "KEPT_BYTES", kept)
        own.clear()
        total = Counter()
        import pyarrow as pa

        for out in token_alignment._count_links(f"{FOLDER}/byte_bpe_50k.tiktoken", f"{FOLDER}/piece_bpe_32k.model")(iter([pa.RecordBatch.from_arrays([texts], ["_text"])])):
            for pair, n in zip(out["pair"].to_pylist(), out["n"].to_pylist(), strict=True):
                total[pair] += n
        totals.append(total)
    assert totals[0] == totals[1]


def test_empty_table(spark, empty):
    assert got(align_tokenizers(empty)) == []
    assert got(align_tokenizers(empty.sparkSession.range(2).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text")))) == [(i, 0, 0, 0, 0, 0, 0, "") for i in range(2)]
