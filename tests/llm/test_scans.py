"""Packing, the token store and mixing, against plain versions of themselves."""

import glob
import os
import random
import subprocess
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F
from tokenizers import Tokenizer

from eavspark.llm import mixing, packing, token_store, tokens
from eavspark.llm.shared import new_path, running_total

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length long, queue string"
ROWS = [
    (1, "The cat's  sat.\n\n on 12 mats", "en", "a", 0, 1, "x"), (2, None, None, None, None, None, None), (3, "", "en", "a", 0, 1, "x"), (4, "ab " * 3000, "en", "b", 0, 1, "x"),
    (4, "ab " * 3000, "en", "b", 0, 1, "x"), (None, "no id", "en", "b", 0, 1, "x"), (5, "日本語 é x", "ja", "c", 0, 1, "x"), (6, "lone", "en", "zz", 0, 1, "x"),
]
TEXTS = [
    "", " ", "a  b", "a   b", " a", "a ", "a \n b", "don't it's", "\n\n", "x\ty", "日本語 text", "é à Ünïcode", "é", "<|endoftext|> hi", "a b", "12345 67", "a\r\nb", "  lead",
    "İstanbul ŉ ǅ", "!!'s", " 's", "''ll", " \n", "a\n ", "a\n b  \n c", "²³ ª", "a\x1cb", "I'LL we'll", "x'sy", "ß ẞ", "naïve—café", "_x_ y_z", "a,b;c  ,", "​zero",
]


def library(name, text):
    return Tokenizer.from_file(tokens.path(name)).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_tokens_are_the_library_s(name):
    """Also for letters that lower to others, and for names of special tokens, which are those tokens."""
    encode, plain = tokens.encoder(tokens.path(name)), Tokenizer.from_file(tokens.path(name))
    rng = random.Random(1)
    chars = [chr(c) for c in [9, 10, 13, *range(0x20, 0x250)]] + list("<|endoftext|>''  \n") * 8
    drawn = ["".join(rng.choice(chars) for _ in range(rng.randrange(1, 25))) for _ in range(20_000)]
    special = ["a <|endoftext|> b", "<|ENDOFTEXT|>x", "<|startoftext|>", "Ɔ.", "(Ɔkyena)", "x" * 300]
    for text in [*TEXTS * 2, *special, *drawn]:
        assert np.frombuffer(encode(text), "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids, text
    assert tokens.kind(tokens.path(name)) == name.split("_")[0]


def test_missed_pieces():
    """One table gives the letters of all bytes; ids are packed as such, few or many."""
    assert len(tokens.TABLE) == 256 and [ord(x) for x in tokens.TABLE] == [tokens.LETTERS.get(b, b) for b in range(256)]
    tokenizer = Tokenizer.from_file(tokens.path("byte_bpe_50k.json"))
    held = tokens.Ids(tokenizer)
    for piece in (" the", "\t\n\r", " \u00e9\u00d6\u017f\u00a1", "?", "!?" * 16, "q?x" * 31, "zq" * 300):
        assert np.frombuffer(held[piece], "<u2").tolist() == [t.id for t in tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(tokens.LETTERS))]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_many_texts_are_encoded_at_once(name, monkeypatch):
    """Pieces are those of the pattern, none reaches over two texts, and one that comes often is looked up once."""
    rng, of = random.Random(2), name.split("_")[0]
    marks = [" ", "  ", "\n", "\t", "'", "''", "'s", "'re", "'ve", "'ll", "'LL", "l", "r", "v", "e", "s", "Zé", "ſ", "ª", "×", "²", "¼", "12", "!", "¡", "_"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(1, 30))) for _ in range(20_000)] + ["'", "s", "' ", "'", "re", "'r", "e"]
    raw = [(t if of == "byte" else t.lower()).encode() for t in texts]
    ends, data = np.cumsum([0, *map(len, raw)]), b"".join(raw)
    at = [*np.flatnonzero(tokens.starts(np.frombuffer(data, np.uint8), ends[:-1], of)).tolist(), len(data)]
    found = [data[a:b].decode() for a, b in zip(at, at[1:])]
    split = tokens.BYTE_SPLIT if of == "byte" else tokens.WORD_SPLIT
    assert [x for x in found if of == "byte" or not x.isspace()] == [x for r in raw for x in split.findall(r.decode())]

    looked = []
    monkeypatch.setattr(tokens.Ids, "__getitem__", lambda self, piece: (looked.append(piece), self.get(piece) or self.__missing__(piece))[1], raising=False)
    encode, plain = tokens.encoders.__wrapped__(tokens.path(name)), Tokenizer.from_file(tokens.path(name))
    some = [*TEXTS, "", "the cat", "<|endoftext|>", *["the cat's the cat"] * 1000, "日本 the"]
    assert [np.frombuffer(x, "<u2").tolist() for x in encode(some)] == [plain.encode(t, add_special_tokens=False).ids for t in some]
    assert len(looked) == len(set(looked)) and encode([]) == [] and encode(["", "a"])[0] == b""


def test_parts_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "BYTES", 10)
    monkeypatch.setattr(tokens, "ROWS", 3)
    texts = pa.array(["a" * 25, None, "", "é" * 5, "b", None, "", "c", "d" * 11])
    got = list(tokens.parts(texts))
    assert got == [(0, 1), (1, 3), (4, 3), (7, 1), (8, 1)] and list(tokens.parts(pa.array([], pa.string()))) == []


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_a_worker_gives_freed_memory_back():
    """In a process of its own: what a task has freed isn't kept until the next one, also when the task isn't read to its end."""
    code = """
import pyarrow as pa
from pathlib import Path
from eavspark.llm import shared
held = lambda: sum(int(x.split()[1]) for x in Path("/proc/self/status").read_text().splitlines() if x.startswith("RssAnon")) / 1024
pins = []
def fn(batches):
    for b in batches:
        kept = [bytearray(b"x" * 20_000) for _ in range(5_000)]
        pins.extend(kept[::100])
        del kept
        yield b
batch = pa.RecordBatch.from_pydict({"a": [1]})
before = held()
assert len(list(shared.lean(fn)([batch, batch]))) == 2
some = shared.lean(fn)([batch, batch])
next(some)
some.close()
assert held() - before < 60, (before, held())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parents[2])


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_holds_every_id_once(spark):
    got = packing.pack(spark.createDataFrame(ROWS, SCHEMA), window=256, packet=64).collect()
    want = sorted(((r[0], tuple(library("word_bpe_49k.json", r[1] or "") + [1])) for r in ROWS), key=str)
    by, windows = defaultdict(list), defaultdict(list)
    for p in got:
        by[p.doc_id].append(p)
        windows[p.sequence_id].append(p)
        assert p.ids_crc32 == crc(p.ids) and len(p.ids) == p.length
    copies = {k: len([1 for r in ROWS if r[0] == k]) for k in by}
    for doc_id, ids in want:
        held = np.zeros(len(ids), int)
        for p in by[doc_id]:
            assert p.doc_tokens == len(ids) and p.ids == list(ids[p.start : p.start + p.length])
            held[p.start : p.start + p.length] += 1
        assert (held == copies[doc_id]).all()
    for k, pieces in windows.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 256 or k == max(windows)


def test_packing_keeps_proportions(spark):
    """Two sources with 3 to 1 tokens: every full window has about that."""
    docs = [(k, "word " * 199, None, "a" if k % 4 else "b", 0, 1, "x") for k in range(400)]
    share = defaultdict(int)
    for p in packing.pack(spark.createDataFrame(docs, SCHEMA), window=2048, packet=128).collect():
        if p.source == "b":
            share[p.sequence_id] += p.length
    full = [share[k] / 2048 for k in range(max(share))]
    assert all(abs(x - 0.25) < 0.13 for x in full) and abs(np.mean(full) - 0.25) < 0.01


@pytest.mark.parametrize("weights", [None, {"a": 4, "b": 2, "c": 1, None: 1}])
def test_packing_is_deficit_round_robin(spark, weights):
    """The stream of packets is that of rounds one after the other, with deficits kept."""
    rng = random.Random(4)
    rows = [(k, rng.choice(["a", "a", "a", "b", "c", None]), rng.randrange(1, 900)) for k in range(150)]
    if weights is None:  # the tokens of each source a power of two of all, so that quanta are whole
        rows = [(k, s, 256) for k, s in enumerate(["a"] * 32 + ["b"] * 16 + ["c"] * 8 + [None] * 8)]
    df = spark.createDataFrame(rows, "row long, source string, n_ids long")
    place = {r.row: r.p for r in df.select("row", F.xxhash64("row").alias("p")).collect()}
    total = defaultdict(int)
    for _, s, n in rows:
        total[s] += n
    weight = weights or total
    quantum = {s: 512 * weight[s] // sum(weight[x] for x in total) for s in total}
    size = {s: min(128, max(packing.FEW, q)) for s, q in quantum.items()}
    queues = {s: [(k, at, min(size[s], n - at)) for k, _, n in sorted((r for r in rows if r[1] == s), key=lambda r: (place[r[0]], r[0])) for at in range(0, n, size[s])] for s in total}
    deficit, sent = dict.fromkeys(total, 0), []
    while any(queues.values()):
        for s in sorted(total, key=lambda s: "-" if s is None else f"={s}"):
            deficit[s] += quantum[s]
            while queues[s] and queues[s][0][2] <= deficit[s]:
                deficit[s] -= queues[s][0][2]
                sent.append(queues[s].pop(0))
    ids = [(k, at + j) for k, at, n in sent for j in range(n)]
    got = sorted(packing.plan(df, 512, 128, weights).collect(), key=lambda r: (r.sequence_id, r.offset))
    assert [(r.row, r.start + j) for r in got for j in range(r.length)] == ids
    assert all(r.offset + r.length <= 512 for r in got)
    if weights:  # while all queues last, every window has the target proportions to a packet
        source = {k: s for k, s, _ in rows}
        for w in range(min(total[s] // quantum[s] for s in total) - 1):
            n = defaultdict(int)
            for r in got:
                if r.sequence_id == w:
                    n[source[r.row]] += r.length
            assert all(abs(n[s] - quantum[s]) <= 2 * size[s] for s in total)


def test_packing_of_nothing(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_store_round_trip(spark):
    path = new_path(spark, "store")
    docs = spark.createDataFrame(ROWS, SCHEMA)
    token_store.write(docs, path)
    got = token_store.digest(spark, path).collect()
    want = sorted([(r[0], library("byte_bpe_50k.json", r[1] or "") + [2]) for r in ROWS], key=lambda x: (x[0] is not None, x[0] or 0))
    assert len(got) == len(ROWS) and all(r.verified for r in got)
    start = 0
    for (doc_id, ids), r in zip(want, sorted(got, key=lambda r: r.start)):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), crc(ids))
        start += len(ids)
    whole = token_store.read_ids(spark, path).collect()
    assert sorted(np.frombuffer(r.ids, "<u2").tolist() for r in whole) == sorted(ids for _, ids in want)
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("key").distinct().count()
    recipes = spark.read.parquet(f"{path}/recipes").count()
    assert recipes == len(ROWS) == spark.read.parquet(f"{path}/manifest").selectExpr("sum(documents)").first()[0]


def test_store_finds_damage(spark, tmp_path):
    path = new_path(spark, "store")
    token_store.write(spark.createDataFrame(ROWS[:1], SCHEMA), path)
    broken = spark.read.parquet(f"{path}/chunks").selectExpr("key", "n", "doc_id", "data").collect()
    import zstandard

    rows = [(bytes(r.key), r.n, None, zstandard.compress(b"\1\0" * r.n)) for r in broken]
    spark.createDataFrame(rows, "key binary, n long, doc_id long, data binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/chunks")
    assert not token_store.digest(spark, path).first().verified


@pytest.mark.parametrize("lost", ["chunks", "manifest", "recipes"])
def test_store_finds_loss(spark, lost):
    """A lost chunk, a changed manifest or a lost recipe is told, and takes no other document away."""
    path = new_path(spark, "store")
    docs = [(k, f"text {k} " * 50, None, None, 0, 0, "") for k in range(20)]
    token_store.write(spark.createDataFrame(docs, SCHEMA), path)
    if lost == "chunks":
        kept = spark.read.parquet(f"{path}/chunks").orderBy("key").collect()
        spark.createDataFrame(kept[1:], "key binary, n long, doc_id long, data binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/chunks")
    elif lost == "manifest":
        made = spark.read.parquet(f"{path}/manifest").collect()
        spark.createDataFrame([(r.file, r.documents, r.first, b"x") for r in made], token_store.MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    else:
        at = sorted(glob.glob(f"{path}/recipes/part-*"))[0]
        rows = spark.read.schema(token_store.RECIPES).parquet(at).collect()
        spark.createDataFrame(rows[1:], token_store.RECIPES).coalesce(1).write.parquet(f"{path}/less")
        os.replace(glob.glob(f"{path}/less/part-*")[0], at)
        for crc in glob.glob(f"{path}/recipes/.part-*"):
            os.remove(crc)
    got = token_store.digest(spark, path).collect()
    bad = [r for r in got if not r.verified]
    assert len(got) == 20 - (lost == "recipes") and {"chunks": len(bad) == 1, "manifest": len(bad) == 20, "recipes": 0 < len(bad) < 20}[lost]


def test_store_of_nothing(spark):
    path = new_path(spark, "store")
    token_store.write(spark.createDataFrame([], SCHEMA), path)
    assert token_store.digest(spark, path).count() == 0


def test_cuts_follow_content():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 50_000, 6000).astype("<u2")
    y = np.concatenate([x[:100], rng.integers(0, 50_000, 7).astype("<u2"), x[100:]])
    a, b = token_store.cuts(x), token_store.cuts(y)
    assert a[-1] == 6000 and len(set(a) & {k - 7 for k in b}) >= len(a) - 2
    assert token_store.cuts(x[:10]) == [10] and max(np.diff([0, *token_store.cuts(np.zeros(9000, "<u2"))])) <= token_store.MOST


def test_checksums_moved_by_zeros():
    rng = np.random.default_rng(1)
    for lengths in ([0, 5], [5, 0], [100, 3000], [3, 1, 70_000, 4], [1 << 20, 1 << 21]):
        parts = [rng.bytes(n) for n in lengths]
        after = np.array([sum(lengths[k + 1 :]) for k in range(len(lengths))])
        moved = token_store.with_zeros(np.array([zlib.crc32(x) for x in parts], np.uint32), after)
        assert np.bitwise_xor.reduce(moved) == zlib.crc32(b"".join(parts))


def test_running_total(spark):
    rows = [(k % 7, k, k * 3 % 11) for k in range(500)]
    got = running_total(spark.createDataFrame(rows, "s long, k long, v long"), ["k"], "v", ["s"]).collect()
    sums = defaultdict(int)
    for s, k, v in rows:
        assert (s, k, v, sums[s]) in {tuple(r) for r in got if r.k == k}
        sums[s] += v
    assert {r.before for r in running_total(spark.createDataFrame(rows, "s long, k long, v long"), ["k"], "v").collect()} == {int(x) for x in np.cumsum([0] + [r[2] for r in rows[:-1]])}


def test_mixing_by_hand(spark):
    docs = [(k, "w " * (k % 9 + 1), "en", s, 0, 1, "x") for k, s in enumerate(["a"] * 50 + ["b"] * 20 + ["c"] * 10 + [None] * 5)]
    docs += [(900, None, "en", "a", 0, 1, "x"), (901, "", "en", "a", 0, 1, "x"), (902, "w w", None, "b", 0, 1, "x"), (902, "w w", None, "b", 0, 1, "x")]
    got = mixing.mix(spark.createDataFrame(docs, SCHEMA)).collect()
    again = mixing.mix(spark.createDataFrame(docs[::-1], SCHEMA).repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == len(docs)
    source = {k: s for k, _, _, s, *_ in docs}
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        s = source[r.doc_id]
        sizes[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 2 * r.size and r.size == len((dict((d[0], d[1]) for d in docs)[r.doc_id] or "").split())
    total = 1.5 * sum(sizes.values())
    assert abs(sum(target.values()) - total) < 1e-6 and abs(sum(taken.values()) - total) <= 1
    for s in target:
        assert target[s] <= 2 * sizes[s] + 1e-9 and abs(taken[s] - target[s]) <= 9
    # null is last: weights are a 5, b 2, c 1, null 5
    free = [s for s in target if target[s] < 2 * sizes[s] - 1e-9]
    weight = {"a": 5, "b": 2, "c": 1, None: 5}
    assert len({round(target[s] / weight[s], 6) for s in free}) <= 1


def test_mixing_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in mixing.mix(spark.createDataFrame([(1, None, None, None, None, None, None)], SCHEMA)).collect()] == [(1, 0, 0, 0.0, 0)]
