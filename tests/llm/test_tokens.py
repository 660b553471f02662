"""Token files, prefix counts and packing against the library's own answers."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import documents, invented, odd_documents, seeded

from rankspark.llm import packing, token_counts, token_files
from rankspark.llm.encode import encoder, vocabulary

NAME = "word_bpe_49k.json"
BITS = ["a", "Zebra", "é", "É", "'s", "'S", "'", "(", "<|", "<|endoftext|>", "<|ENDOFTEXT|>", "_", "-", "1", "23", ".", ",", "..", " ", "\n",
        "\t", "\x1c", " ", "́", "Σ", "ſ", "İ", "ŉ", "🙂", "ß", "ẞ", "×", "日本", "thion", "Ī", "%", "$$", "***"]


def odd_texts(n=400):
    rng = seeded(8)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(1, 12))) for _ in range(n)] + [invented(rng, 80), "", " \n"]


@pytest.mark.parametrize("name", [NAME, "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_ids_are_the_librarys(name):
    coder = encoder(vocabulary(name))
    for text in odd_texts(400 if name == NAME else 60):
        assert np.frombuffer(coder.ids(text), coder.dtype).tolist() == coder.direct(text)


def test_full_memos_change_nothing(monkeypatch):
    from rankspark.llm import encode

    monkeypatch.setattr(encode, "MEMO_WORDS", 3)
    monkeypatch.setattr(encode, "MEMO_CHUNKS", 2)
    coder = encode.Encoder(vocabulary(NAME))
    for text in odd_texts(80):
        assert np.frombuffer(coder.ids(text), coder.dtype).tolist() == coder.direct(text)


@pytest.mark.parametrize("name", [NAME, "byte_bpe_50k.json"])
def test_every_prefix(name):
    coder, rng = encoder(vocabulary(name)), seeded(3)
    for text in odd_texts(40):
        table = token_counts.PrefixCounts(text, coder)
        assert table.total() == len(coder.direct(text)) and len(table.spans) == len(table.counts)
        for chars in range(len(text) + 1):
            assert table.at(chars) == len(coder.direct(text[:chars]))
        budget = rng.randint(0, 6)
        fits = table.longest_within(budget)
        assert len(coder.direct(text[:fits])) <= budget or fits == 0


ROWS = [(3, "One two, three."), (1, None), (2, ""), (7, "word " * 30_000), (None, "x"), (9, "same"), (9, "same")]


def test_token_files(spark, tmp_path):
    rng = seeded(6)
    rows = ROWS + [(k, invented(rng, rng.randint(1, 300))) for k in range(20, 60)]
    manifest = token_files.write_token_files(odd_documents(spark, rows).repartition(3), str(tmp_path / "ids"), length=64)
    got = token_files.read_documents(manifest, str(tmp_path / "ids")).orderBy("start").collect()
    coder, at = encoder(vocabulary(NAME)), 0
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    whole = []
    for r, (key, text) in zip(got, ordered):
        ids = [*coder.direct(text or ""), 2]
        whole += ids
        assert (r.doc_id, r.start, r.n_tokens) == (key, at, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.asarray(ids, "<u4").tobytes())
        at += len(ids)
    flat = []
    from pyarrow import fs
    for f in manifest.orderBy("file").collect():
        table = pa.ipc.open_stream(pa.memory_map(f.path)).read_all()
        assert pa.types.is_fixed_size_list(table.schema.field("ids").type)
        held = token_files.TokenFile(fs.LocalFileSystem(), f.path)
        for i in range(len(held)):
            ids, mask = held.sequence(i)
            mask = np.array(mask.to_pylist())
            assert ids.shape == mask.shape == (64,) and (mask.all() or i == len(held) - 1)
            flat += ids[mask].tolist()
    assert flat == whole
    assert token_files.token_output(documents(spark, [])).count() == 0


def test_sequences_are_views(tmp_path):
    from pyarrow import fs

    path, rng = str(tmp_path / "ids.arrow"), np.random.default_rng(1)
    ids = rng.integers(0, 49_000, 8 * 700 + 3).astype("<u2")
    with pa.OSFile(path, "wb") as sink:  # 300 sequences at once make a batch of 256 and one of 44
        writer = token_files._SequenceWriter(sink, ids.dtype, 8)
        for part in (ids[:2400], ids[2400:2405], ids[2405:]):
            writer.add(part.tobytes())
        writer.close()
    held = token_files.TokenFile(fs.LocalFileSystem(), path)
    assert len(held) == 701 and len(held.batches) > 2 and held.n_tokens() == len(ids)
    for i in (0, 255, 256, 299, 300, 699, 700):
        got, mask = held.sequence(i)
        n = min(8, len(ids) - 8 * i)
        assert got[:n].tolist() == ids[8 * i: 8 * i + n].tolist() and mask.to_pylist() == [True] * n + [False] * (8 - n)
        assert not got.flags.owndata and any(  # it lies in a batch's own buffer
            b.column("ids").values.buffers()[1].address <= got.ctypes.data < b.column("ids").values.buffers()[1].address
            + b.column("ids").values.buffers()[1].size for b in held.batches)
    for a, b in ((0, len(ids)), (5, 5), (2040, 2060), (2399, 2401), (4000, len(ids)), (8, 9)):
        assert [int(x) for part in held.parts(a, b) for x in part] == ids[a:b].tolist()
    for i in (-1, 701):
        with pytest.raises(IndexError):
            held.sequence(i)


def test_token_counts(spark):
    coder = encoder(vocabulary(NAME))
    got = token_counts.token_counts(odd_documents(spark, ROWS), limit=5, with_prefixes=True).collect()
    want = [(i, len((t or "").encode()), len(coder.direct(t or ""))) for i, t in ROWS]
    assert [(r.doc_id, r.n_bytes, r.n_tokens) for r in got] == want
    assert all(r.over_limit == (r.n_tokens > 5) and (r.prefix_counts or [0])[-1] == r.n_tokens for r in got)
    assert token_counts.token_counts(documents(spark, [])).count() == 0


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))


def test_bounds_are_optimal():
    from itertools import combinations

    rng = seeded(1)
    for _ in range(40):
        lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 9)))
        counts = [rng.randint(1, 50) for _ in lengths]
        k = rng.randint(1, 4)
        got = packing.best_bounds(lengths, counts, k)
        best = min(padding(lengths, counts, [*c, lengths[-1]]) for n in range(k) for c in combinations(lengths[:-1], n))
        assert len(got) <= k and padding(lengths, counts, got) == best
    assert packing.best_bounds([], []) == []


def test_packing(spark):
    rng = seeded(2)
    rows = ROWS + [(k, invented(rng, rng.randint(1, 60))) for k in range(20, 400)]
    got = packing.pack(odd_documents(spark, rows), max_length=64, buckets=4, budget=256).collect()
    coder = encoder(vocabulary(NAME))
    want = sorted((i or 0, len(coder.direct(t or "")) + 1) for i, t in rows)
    sums = {}
    for r in got:
        sums[r.doc_id or 0] = sums.get(r.doc_id or 0, 0) + r.length
        assert 1 <= r.length <= r.pad_to <= 64
    per_id = {}
    for i, n in want:
        per_id[i] = per_id.get(i, 0) + n
    assert sums == per_id
    lengths, counts = zip(*sorted({n: sum(r.length == n for r in got) for n in {r.length for r in got}}.items()))
    assert sorted({r.pad_to for r in got}) == packing.best_bounds(list(lengths), list(counts), 4)
    batches = {}
    for r in got:
        batches.setdefault((r.pad_to, r.batch), []).append(r.slot)
    for (pad, batch), slots in batches.items():
        room = 256 // pad
        last = batch == max(b for p, b in batches if p == pad)
        assert sorted(slots) == list(range(len(slots))) and (len(slots) == room or last and len(slots) <= room)
    assert packing.pack(documents(spark, [])).count() == 0
