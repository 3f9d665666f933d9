"""The pipeline's stages on odd rows, against brute force."""

import random
from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline
from sweeplens.llm.queries import tokenizer_path
from sweeplens.llm.shared import written

LABELS = "doc_id bigint, quality int, toxic int"


def test_pipeline_edges(spark, tmp_path):
    """Every stage on nulls, empty and long texts, repeated rows, copies and extra columns, against brute force."""
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(900)]

    def text(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    passage, original, very_long = text(70), text(200), text(30_000)
    rows = [(i, text(rng.randrange(20, 150)) + (" idiot scum" if i % 4 == 0 else ""), "a" if i % 3 else "b") for i in range(60)]
    rows += [(100, original, "a"), (101, original + " tail", "b"), (102, original, None), (102, original, None)]
    rows += [(200, text(30) + " " + passage + " " + text(30), "a"), (201, passage + " " + text(40), "c"), (202, text(9) + " " + passage, "c")]
    rows += [(300, None, "a"), (301, "", "a"), (302, " \n", None), (303, "one", "a"), (304, very_long, "b"), (None, text(60), "a"), (None, None, None)]
    docs = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 7, [i]) for i, t, s in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint, score int, sequence_id array<bigint>")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(i % 4 == 0)) for i in range(60)]
    spark.createDataFrame(labels, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)

    kept, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, sf)
        assert out.columns == docs.columns
        kept = written(out, name)
        seen.append(kept.collect())
        empty = stage(spark, docs.limit(0), sf)
        assert empty.columns == docs.columns and empty.count() == 0
    toxic, near, repeats, mixture = seen
    assert {r["doc_id"] for r in toxic} == {i for i, _, _ in rows if not (i is not None and i < 60 and i % 4 == 0)}

    def shingles(t, k=5):
        words = (t or "").lower().split()
        return {" ".join(words[i: i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()

    sets = [(r, shingles(r["text"])) for r in near]
    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            assert not a or not b or 100 * len(a & b) < 80 * len(a | b)
    group = {100, 101, 102}
    assert len([r for r in near if r["doc_id"] in group]) == 1
    assert {r["doc_id"] for r in near} - group == {r["doc_id"] for r in toxic} - group
    holding = [r["doc_id"] for r in repeats if passage in (r["text"] or "")]
    assert holding == [200] and len(repeats) == len(near)
    assert all(r["n_chars"] == len(r["text"]) for r in repeats if r["doc_id"] in (201, 202))
    assert {(r["doc_id"], r["text"]) for r in mixture} == {(r["doc_id"], r["text"]) for r in repeats}

    last = corpus_pipeline.STAGES[-1][1](spark, kept, sf).collect()
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = Counter()
    for r in mixture:
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1
        want.update((r["doc_id"], p, p * 2048, min(2048, n - p * 2048)) for p in range(-(-n // 2048)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in last) == want
    places = {}
    for r in last:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        ends = [0]
        for offset, length in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 2048
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0
