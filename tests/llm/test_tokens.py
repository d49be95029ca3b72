"""Token files, BPE, packing."""

import glob
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from common import DOCS, TEXTS, VOCABULARY, clashing, docs, tokenizer

from driftwell.llm import bpe, packing, token_files
from driftwell.llm.arrow import blocks
from driftwell.llm.tokens import Encoder

PIECES = ["a", "the ", " cat", "  ", "\n", "\t", "'s", "'ll", "é", "日本", "1", "23", "!", "...", "#", " ", "👍", "<|endoftext|>", "\r\n", "ing", "   x", "Zz"]


def mixed(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


#: All of Unicode's white space, characters that Python alone calls so, and some that look so.
SPACES = [" ", " ", " ", "\n", "\t", "\r", *map(chr, [0xB, 0xC, 0x1C, 0x1F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]
WORDS = ["a", "Hello", "brave", "'s", "'re", "'", "don't", "12", "é", "日本", "!", "...", "<|endoftext|>", "<|", "word.", "x,", "café.", "’", "😀", "\0"]


def spaced(rng):
    return "".join(rng.choice(SPACES) if rng.random() < 0.45 else rng.choice(WORDS) for _ in range(rng.randrange(1, 12)))


def ids_of(t, text):
    return np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_both_encoders_agree_with_the_library():
    t, fast, streamed = tokenizer(), Encoder(VOCABULARY, memo=50), bpe.StreamEncoder(VOCABULARY, memo=50)
    for text in [x or "" for x in TEXTS] + mixed(600, 3):
        want = ids_of(t, text)
        assert fast.one(text) == want
        assert streamed.one(text) == want


def test_odd_white_space_whatever_the_memo_holds():
    t, rng, fast, streamed = tokenizer(), random.Random(5), Encoder(VOCABULARY), bpe.StreamEncoder(VOCABULARY)
    for i, text in enumerate(["\xa0", "\xa0\xa0Hello", "\xa0\xa0Hello brave", "a\xa0", *(spaced(rng) for _ in range(100_000))]):
        want = ids_of(t, text)
        assert fast.one(text) == want, repr(text)
        if i % 10 == 0:
            assert streamed.one(text) == want, repr(text)
            fast._known.clear()  # empty for the next text, ever fuller for the nine after it


@pytest.mark.parametrize("memo", [50, 600_000])
def test_columns_of_texts_agree_with_the_library(memo):
    t, rng, fast = tokenizer(), random.Random(7), Encoder(VOCABULARY, memo=memo)
    pool = TEXTS + mixed(600, 3) + [spaced(rng) for _ in range(10_000)]
    want = {x: ids_of(t, x or "") for x in pool}
    for size in [0, 1, 2, 5, 300] * 8:
        texts = rng.choices(pool, k=size + 2)
        assert fast.many(pa.array(texts, pa.string()).slice(2)) == [want[x] for x in texts[2:]]
    for text in TEXTS:
        assert fast.many(pa.array([text], pa.string())) == [want[text]]
    assert fast.many(pa.array(pool, pa.string())) == [want[x] for x in pool]
    assert [fast.one(x) for x in pool] == [want[x] for x in pool]


def test_parts_of_many_texts_are_looked_up_and_learned_together(monkeypatch):
    fast, calls, looked = Encoder(VOCABULARY), [], []
    encode = fast._ids
    monkeypatch.setattr(fast, "_ids", lambda text: calls.append(text) or encode(text))

    class Counted(dict):
        def get(self, part):
            looked.append(part)
            return super().get(part)

    fast._known = Counted()
    texts = [f"the same few words and quux{i}yz here" for i in range(1000)]
    got = fast.many(pa.array(texts))
    assert len(calls) <= 4  # 1006 different parts, not 1000 texts
    assert len(looked) == len(set(looked)) == 1006
    assert got == [ids_of(tokenizer(), x) for x in texts[:1]] + [fast.one(x) for x in texts[1:]]


def test_memo_stays_within_its_bound_in_one_odd_text():
    fast = Encoder(VOCABULARY, memo=50)
    text = "two  spaces " + " ".join(f"quux{i}yz" for i in range(1000))
    assert b"".join(fast._loose(text)) == ids_of(tokenizer(), text)
    assert len(fast._known) <= 52


def test_blocks_are_cut_by_bytes():
    texts = ["é" * 30, None, "", "a" * 500, "b" * 40, "c" * 40, "d" * 40]
    batches = [pa.record_batch([pa.array(range(7)), pa.array(texts)], ["id", "text"]).slice(i, n) for i, n in ((0, 0), (0, 7), (4, 3))]
    got = [b.column(0).to_pylist() for b in blocks(iter(batches), 1, 100)]
    assert got == [[0, 1, 2], [3], [4, 5], [6], [4, 5], [6]]


def test_stream_in_small_chunks_is_the_whole_text():
    t = tokenizer()
    for size in (1, 7, 613, 5000):
        e = bpe.StreamEncoder(VOCABULARY, chunk=size)
        for text in [x for x in TEXTS if x and (size > 7 or len(x) < 2000)] + mixed(100, 9):
            assert e.one(text) == ids_of(t, text)


def test_every_text_goes_through_the_stream_and_memory_stays(monkeypatch):
    fed, held, parts = [], [], []
    feed, push = bpe.TokenStream.feed, bpe.Transducer.feed

    def counted(self, chunk):
        out = feed(self, chunk)
        fed.append(len(chunk))
        held.append(len(self._held))
        return out

    def pushed(self, raw):
        yield from push(self, raw)
        parts.append(len(self._pending))

    monkeypatch.setattr(bpe.TokenStream, "feed", counted)
    monkeypatch.setattr(bpe.Transducer, "feed", pushed)
    e = bpe.StreamEncoder(VOCABULARY)
    for text in TEXTS:
        before = sum(fed)
        e.one(text)
        assert sum(fed) - before == len((text or "").replace("<|endoftext|>", ""))
    assert parts and max(fed) <= 4096 + 13 and max(held) <= 8192
    held.clear(), parts.clear()
    for _ in e.blocks("日本" * 2048 for _ in range(300)):  # one run of 1.2 million characters, which need not be there at once
        pass
    assert max(held) <= 8192 and max(parts) <= e.merges.lookahead + 2 * 4096


@pytest.mark.parametrize("unit", ["x", "ab", "aaab", "the", "日", "-", "=-", "7"])
def test_transducer_holds_little_and_is_exact(unit):
    merges, t = bpe.Merges(VOCABULARY), tokenizer()
    raw = unit * (20000 // len(unit))
    machine, got = bpe.Transducer(merges, block=256), []
    for i in range(0, len(raw.encode()), 100):
        got += machine.feed(raw.encode()[i : i + 100])
        assert len(machine._pending) <= merges.lookahead + 256 + 100
    got += machine.finish()
    assert got == t.encode(raw, add_special_tokens=False).ids


def test_bpe_round_trip_and_decode(spark):
    t, df = tokenizer(), clashing(docs(spark), "ids", "n_tokens", "decoded")
    out = bpe.encode(df, VOCABULARY, decoded=True)
    for r in out.collect():
        ids = t.encode(TEXTS[r.doc_id - 1] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded == t.decode(ids, skip_special_tokens=False)
    back = {r.doc_id: r.text for r in bpe.decode(out, VOCABULARY).collect()}
    assert all(back[i + 1] == (x or "") for i, x in enumerate(TEXTS))
    assert bpe.encode(spark.createDataFrame([], DOCS), VOCABULARY).count() == 0


def test_decode_machine_cuts_characters_anywhere():
    merges, t = bpe.Merges(VOCABULARY), tokenizer()
    ids = t.encode("日本語 👩‍👧 é", add_special_tokens=False).ids
    for broken in (ids, ids[:3], ids[1:], ids[::2]):
        blocks = [np.array([i], "<u4").tobytes() for i in broken]
        assert "".join(bpe.decode_stream(blocks, merges)) == t.decode(broken, skip_special_tokens=False)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, tmp_path, encoding):
    df = clashing(docs(spark).union(spark.createDataFrame([(None, "null id", "en", "web", 7), (5, "again five", None, None, None)], DOCS)), "ids", "part", "first")
    path = f"file://{tmp_path}/ids"
    token_files.write_tokens(df, path, VOCABULARY, encoding=encoding, page_rows=4, files=3)
    rows = token_files.with_starts(token_files.read_tokens(spark, path)).orderBy("start").collect()
    t, at = tokenizer(), 0
    texts = sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is not None, r[0], r[1] or ""))
    assert [r.doc_id for r in rows] == [i for i, _ in texts]
    for r, (_, text) in zip(rows, texts, strict=True):
        assert r.start == at and r.ids == [*t.encode(text or "", add_special_tokens=False).ids, 2] and r.n_tokens == len(r.ids)
        at += r.n_tokens
    for f in glob.glob(f"{tmp_path}/ids/*.parquet"):
        group = pq.ParquetFile(f).metadata.row_group(0)
        column = next(group.column(i) for i in range(group.num_columns) if group.column(i).path_in_schema.startswith("ids"))
        assert column.has_offset_index and column.has_column_index
        assert any("DICTIONARY" in x for x in column.encodings) if encoding == "dictionary" else "DELTA_BINARY_PACKED" in column.encodings
    few = token_files.read_tokens(spark, path, ["doc_id", "n_tokens"], "doc_id = 7")
    assert few.count() == 1 and "ids" not in few._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    crc = {(r.doc_id, r.n_tokens): r.ids_crc32 for r in token_files.ids_crc32(token_files.read_tokens(spark, path), ["doc_id", "n_tokens"]).collect()}
    assert all(crc[r.doc_id, r.n_tokens] == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows)


def test_token_files_of_an_empty_table(spark, tmp_path):
    token_files.write_tokens(spark.createDataFrame([], DOCS), f"file://{tmp_path}/none", VOCABULARY)
    assert token_files.with_starts(token_files.read_tokens(spark, f"file://{tmp_path}/none")).count() == 0


def check_packed(rows, texts, capacity):
    t = tokenizer()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for i, text in texts.items():
        want = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        parts = sorted(by_doc[i], key=lambda r: r.start)
        assert b"".join(r.ids for r in parts) == want and all(4 * r.length == len(r.ids) and r.doc_tokens == len(want) // 4 for r in parts)
        assert all(a.start + a.length == b.start for a, b in zip(parts, parts[1:], strict=False)) and parts[0].start == 0
    short = 0
    for parts in by_seq.values():
        parts.sort(key=lambda r: r.offset)
        assert parts[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in zip(parts, parts[1:], strict=False))
        n = sum(r.length for r in parts)
        assert 0 < n <= capacity
        short += n < capacity
    return short


def test_packing(spark, sf_dir):
    df = clashing(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").repartition(3), "ids", "start")
    rows = packing.pack(df, VOCABULARY, pool=16).collect()
    assert check_packed(rows, {r.doc_id: r.text for r in df.collect()}, 1024) <= 3


def test_packing_edges(spark):
    rows = packing.pack(docs(spark).coalesce(1), VOCABULARY, capacity=64).collect()
    assert check_packed(rows, dict(enumerate(TEXTS, 1)), 64) <= 1
    assert packing.pack(spark.createDataFrame([], DOCS), VOCABULARY).count() == 0


@pytest.mark.parametrize(("texts", "pool"), [
    ([None, "", "a cat"] * 3000, 4096), ([""] * 4200, 4096), (["one two three " * (i % 9) for i in range(5000)], 4096), (["a cat", ""] * 700, 16),
])
def test_packing_of_many_short_documents_in_one_task(spark, texts, pool):
    rows = packing.pack(docs(spark, texts).coalesce(1), VOCABULARY, pool=pool).collect()
    assert check_packed(rows, dict(enumerate(texts, 1)), 1024) <= 1


def test_best_fill_is_the_closest_to_the_room():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(rng.randrange(0, 6))}
        room = rng.randrange(0, 90)
        sums = {0}
        for n, c in counts.items():
            sums = {s + k * n for s in sums for k in range(c + 1)}
        got = packing.best_fill(counts, room)
        assert all(got[n] <= counts[n] for n in got)
        assert sum(n * c for n, c in got.items()) == max(s for s in sums if s <= room)
