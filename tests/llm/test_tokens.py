"""Token ids, frame files and packing against the tokenizers library and plain Python."""

import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs
from tokenizers import Tokenizer

from sweeplens.llm import packing, tokenfile, tokens
from sweeplens.llm.queries import tokenizer_path

ODD = ["", None, " ", "  a", "a  b", "a \n b", "x\n\n y z ", "it's don't 'S 12 345", "<|endoftext|> a <|endoftext|>b", "a\u00a0 b", "\u0130 I", "J\u030c Abc",
       "a,b c.", "a\nb", ",\nb", "\t a", "\n", "A,\u00e9", "\u00e9, \u00fc.", ".'s", "foo$$$ %%% a-b_c", "X<b>y|z", "a\r\nb", "1,2 a1b2", "\u65e5\u672c \u8a9e", "a\x1c b\x85 c",
       "word " * 3000, "e\u0301 \u0301a", "\u1e9e \u03a3\u03a3"]
BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
DOCS = "doc_id bigint, text string, start int, length string"


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder(path):
    own, library = tokens.Encoder(tokens.tokenizer_json(path)), Tokenizer.from_file(path)
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(" \n.,'ab\u00e9A1<|\u00a0\u3000\u2003\u200b\u0085\x1c") for _ in range(rng.randrange(40))) for _ in range(2000)]
    ids, first = own.encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[first[i]: first[i + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_forgets_some_pieces_and_stays_right(path, monkeypatch):
    monkeypatch.setattr(tokens, "CACHED", 300)
    own, library = tokens.Encoder(tokens.tokenizer_json(path)), Tokenizer.from_file(path)
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    for turn in range(40):
        texts = [" ".join([*words[:10], *(rng.choice(words) for _ in range(30))]) for _ in range(3)]
        ids, first = own.encode(pa.array(texts))
        for i, text in enumerate(texts):
            assert ids[first[i]: first[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids
        if turn == 30:
            own.rest()
            assert not own.place and not own.used
    assert own.uses[: own.used].max() > 1


def test_encoder_remembers_pieces_in_little_memory():
    own, n = tokens.Encoder(tokens.tokenizer_json(WORD)), 50_000
    own.encode(pa.array(["a"]))  # what does not depend on the pieces is there from now on
    rng = random.Random(8)
    words = {"".join(rng.choices("abcdefgh", k=8)) for _ in range(n)}
    tracemalloc.start()
    own.encode(pa.array([" ".join(words)]))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert own.used > len(words) > n * 0.99
    assert held < 100 * len(words)


def docs(spark):
    return spark.createDataFrame([(5 * i if i % 3 else 5 * i - 2, t, 7, "x") for i, t in enumerate(ODD)] + [(None, "no id", 7, "x"), (0, "again", 7, "x")], DOCS)


def wanted(rows, path):
    """(doc_id, start, n, crc) in file order."""
    library, at, out = Tokenizer.from_file(path), 0, []
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "")):
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        out.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_files_round_trip(spark):
    df = docs(spark)
    manifest = tokenfile.write(df, BYTE, frame_ids=100)  # documents longer than a frame go on in the next
    got = sorted(map(tuple, tokenfile.read(manifest).collect()), key=lambda r: r[1])
    assert got == wanted(df.collect(), BYTE)
    library = Tokenizer.from_file(BYTE)
    asked = {r["doc_id"]: [library.encode(r["text"] or "", add_special_tokens=False).ids + [0]] for r in df.collect() if r["doc_id"]}
    found: dict = {}
    for row in manifest.collect():
        for d, lists in tokenfile.lookup(row["path"], list(asked)).items():
            found.setdefault(d, []).extend(x.tolist() for x in lists)
    assert found == asked
    assert tokenfile.read(tokenfile.write(df.where("false"), BYTE)).count() == 0


def test_lookup_reads_few_frames_and_checks_them(tmp_path):
    files = fs.LocalFileSystem()
    with files.open_output_stream(str(tmp_path / "x"), compression=None) as stream:
        writer = tokenfile.Writer(stream, frame_ids=50)
        for d in range(40):
            writer.add(d, np.arange(d, d + 30, dtype=np.uint32))
        writer.close()
    import zstandard

    assert len(zstandard.ZstdDecompressor().stream_reader(open(tmp_path / "x", "rb"), read_across_frames=True).read()) > 40 * 30 * 4
    reader = tokenfile.Reader(files.open_input_file(str(tmp_path / "x")))
    read = []
    frame = reader.frame
    reader.frame = lambda i: read.append(i) or frame(i)
    assert reader.document(17)[0].tolist() == list(range(17, 47)) and len(read) <= 2 < len(reader.seek)
    data = bytearray((tmp_path / "x").read_bytes())
    end = int(reader.begin[1])
    data[end - 2] ^= 1
    (tmp_path / "y").write_bytes(bytes(data))
    with pytest.raises(Exception):
        tokenfile.Reader(files.open_input_file(str(tmp_path / "y"))).document(0)


@pytest.mark.parametrize("lengths", [[], [2048], [1], [1024] * 3, [2047] * 5, [700] * 50 + [648] * 20, list(range(1, 2049)), [3] * 5000 + [2000] * 40])
def test_plan(lengths):
    found = packing.plan(dict(Counter(lengths)), 2048)
    assert all(sum(p) <= 2048 and t > 0 for p, t in found)
    used = Counter()
    for p, t in found:
        for x in p:
            used[x] += t
    assert used == Counter(lengths)
    best_fit = sum(t for _, t in packing.filled(dict(Counter(lengths)), 2048, 0))
    assert -(-sum(lengths) // 2048) <= sum(t for _, t in found) <= best_fit


def test_exact_complements_are_found():
    found = packing.plan({2000: 3, 40: 3, 8: 3, 1500: 1, 300: 1, 200: 1, 48: 1}, 2048)
    assert sum(t for _, t in found) == 4


def test_packing(spark):
    df = docs(spark)
    size = 64
    rows = packing.pack(packing.pieces(df, WORD, size), size).collect()
    library = Tokenizer.from_file(WORD)
    want = Counter()
    for r in df.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        for i in range(0, len(ids), size):
            part = ids[i: i + size]
            want[(r["doc_id"], i // size, i, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert len(by) <= -(-sum(r["length"] for r in rows) // size) + 1
    assert packing.pack(packing.pieces(df.where("false"), WORD)).count() == 0
