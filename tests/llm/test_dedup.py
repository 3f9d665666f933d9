"""Near copies and repeated passages against plain Python."""

import random
import re

import pytest

from sweeplens.llm import jaccard, passages, shared

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, n_chars bigint, row string, s int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingle_set(text, k):
    w = words(text)
    return {tuple(w[i: i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, over, under):
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and under * len(a & b) >= over * len(a | b):
                parent[root(x)] = root(y)
    least = {}
    for x, (i, s) in enumerate(sets):
        if i is not None and s:
            least[root(x)] = min(i, least.get(root(x), i))
    return sorted(((i, len(s), least.get(root(x)) if s else i) for x, (i, s) in enumerate(sets)), key=str)


def corpus(seed=5, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 9, 30, 80, 200]))] for _ in range(40)]
    rows = []
    for i in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        rows.append((i * 3 % n, " ".join(text)))
    hot = [rng.choice(vocabulary) for _ in range(120)]  # a group of near copies, each with an own word
    rows += [(1000 + i, " ".join(hot[:i] + [f"own{i}"] + hot[i + 1:])) for i in range(40)]
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "One"), (2004, "ONE"), (2005, "one\x0btwo"), (2006, "one two"), (None, "one two"), (None, "alone here now again"),
             (5, "a repeated id with another text of its own kind"), (2007, "one two"), (2008, "long " * 30000)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, len(t or ""), "x", 1) for i, t in rows], DOCS)


@pytest.mark.parametrize("k,over,chunk,small", [(3, 90, 512, 48), (5, 80, 512, 48), (3, 80, 4, 3)])
def test_classes(spark, monkeypatch, k, over, chunk, small):
    for name, value in (("CHUNK", chunk), ("SMALL", small), ("LARGEST", 16_384 if small > 3 else 5)):
        monkeypatch.setattr(jaccard, name, value)
    rows = corpus()
    got = jaccard.classes(frame(spark, rows), jaccard.Rule(k, over, 100)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, k, over, 100)


def test_edges_are_made_and_contracted_by_one_worker_a_task(spark, monkeypatch):
    plans, write = [], shared.written

    def seen(df, label):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(shared, "written", seen)
    monkeypatch.setattr(jaccard, "LARGEST", 5)
    jaccard.classes(frame(spark, corpus(n=60)), jaccard.Rule(3, 90, 100)).count()
    assert sum("MapInArrow" in p for p in plans) > 1
    for plan in plans:
        above = []  # the nodes above a line, as far as its task
        for line in plan.splitlines():
            depth = len(re.match(r"[\s:+-]*", line)[0])
            above = [x for x in above if x[0] < depth]
            if line[depth:].startswith("MapInArrow"):
                assert not any(x[1].startswith("MapInArrow") for x in above), plan
            above = [] if line[depth:].startswith("Repartition") else [*above, (depth, line[depth:])]


def test_one_each_and_empty(spark):
    rows = [(i, t) for i, (_, t) in enumerate(corpus(n=60))]
    want = sorted(i for i, n, c in brute(rows, 5, 80, 100) if i == c)
    rows += [(5000, "twice the same row"), (5000, "twice the same row"), (None, rows[0][1]), (None, "alone without an id")]
    kept = jaccard.one_each(frame(spark, rows), jaccard.Rule(5, 80, 100))
    assert kept.columns == ["doc_id", "text", "n_chars", "row", "s"]
    found = kept.collect()
    assert sorted(r["doc_id"] for r in found if r["doc_id"] is not None) == [*want, 5000]
    assert [r["text"] for r in found if r["doc_id"] is None] == ["alone without an id"]
    empty = frame(spark, rows[:1]).where("false")
    assert jaccard.classes(empty).count() == 0 and jaccard.one_each(empty).count() == 0


def test_windows():
    rng = random.Random(2)
    import numpy as np

    values = np.array([rng.randrange(20) for _ in range(60)])
    begin, middle, end = passages.windows(values, 5)
    for a in range(60):
        for b in range(a + 5, 61):
            c = a + int(values[a:b].argmin())
            assert any(x <= a and b <= z and y == c for x, y, z in zip(begin, middle, end))
    assert passages.windows(values[:4], 5) == ([], [], [])


def planted(rng, size):
    return " ".join(f"p{rng.randrange(10**6)}" for _ in range(size))


def test_passages(spark):
    rng = random.Random(4)
    shared, near, short, line = planted(rng, 70), planted(rng, 120).split(), planted(rng, 40), planted(rng, 8)
    changed = list(near)
    changed[60] = "edited"
    noise = lambda n: planted(rng, n)
    rows = [(10, f"{noise(100)} {shared} {noise(30)}"), (20, f"{noise(5)}\n{shared.upper()}\t{noise(60)}"), (30, f"{noise(80)} {shared}"),
            (40, " ".join(near) + " " + noise(30)), (50, noise(30) + " " + " ".join(changed)), (60, f"{noise(60)} {short} {noise(60)}"), (70, f"{noise(60)} {short} {noise(60)}")]
    rows += [(100 + i, f"{noise(60)} {line} {noise(60)}") for i in range(30)]  # a common line is no passage
    rows += [(200, f"éè {noise(20)}"), (201, None), (202, ""), (None, noise(60))]
    rows += [(300 + i, "copy " + shared + " tail") for i in range(40)]
    df = frame(spark, rows)
    spans = passages.repeated(df)
    got = {r["doc_id"]: r for r in passages.merged(spans).collect()}
    assert set(got) == {20, 30, 50} | set(range(300, 340))
    text = dict(rows)
    assert text[20][got[20]["begin"]: got[20]["end"]] == shared.upper() and got[20]["first_doc_id"] == 10
    assert text[30][got[30]["begin"]: got[30]["end"]] == shared and got[30]["words"] == 70
    assert "edited" in text[50][got[50]["begin"]: got[50]["end"]] and got[50]["first_doc_id"] == 40
    assert all(shared in text[i][got[i]["begin"]: got[i]["end"]] for i in range(300, 340))
    out = passages.removed(df, spans)
    assert out.columns == df.columns
    left = {r["doc_id"]: r for r in out.collect()}
    assert len(left) == len(text) and out.count() == len(rows)
    for i, t in rows:
        if i in got:
            want = t[: got[i]["begin"]] + t[got[i]["end"]:]
            assert (left[i]["text"], left[i]["n_chars"]) == (want, len(want))
        else:
            assert left[i]["text"] == t
    assert passages.repeated(df.where("false")).count() == 0
    assert passages.removed(df.where("false"), spans).count() == 0


def test_matches_of_repetitive_texts():
    import numpy as np

    a = np.array([1, 2, 3] * 30 + [9], dtype=np.uint64)
    found = passages.matches(a, a, passages.Rule(words=1, shortest=20))
    assert found == [(0, 91, 0, 91)]
    assert passages.matches(a, a[:0], passages.Rule()) == []


def test_matches_go_by_the_longest_run_through_a_place():
    import numpy as np

    rule = passages.Rule()
    rng = np.random.default_rng(3)
    new = lambda n: rng.integers(0, 2**60, n).astype(np.uint64)
    passage = new(51)
    a = np.concatenate((new(20), passage[:6], new(60), passage, new(20)))  # the opening line stands alone early on
    b = np.concatenate((new(15), passage, new(9)))
    assert passages.matches(a, b, rule) == [(86, 137, 15, 66)]
    assert passages.matches(b, a, rule) == [(15, 66, 86, 137)]
    near = passage.copy()
    near[25] = a[2]  # a stray hit between two parts
    assert passages.matches(a, np.concatenate((new(15), near, new(9))), rule) == [(86, 137, 15, 66)]
    noisy = np.concatenate([np.append(np.repeat(passage[:1], 30), x) for x in new(200)])  # one shingle nearly everywhere
    found = passages.matches(np.concatenate((noisy[:3000], passage)), np.concatenate((noisy[3100:], passage, noisy[4000:4100])), rule)
    assert any(y <= len(noisy) - 3100 and y_end >= len(noisy) - 3100 + 51 for _, _, y, y_end in found)


def test_passages_behind_a_first_text_that_has_a_part(spark):
    rng = random.Random(9)
    rows, line = [], planted(rng, 20)  # the line holds whole signatures
    for n in range(12):
        passage = planted(rng, 51)
        part = " ".join(passage.split()[:49] if n % 2 else passage.split()[2:])
        rows += [(n, f"{planted(rng, 40)} {part} {planted(rng, 40)}")]
        rows += [(i + n, f"{planted(rng, 40)} {passage} {planted(rng, 40)}") for i in (100, 200)]
        common = f"{planted(rng, 18)} {line} {planted(rng, 18)}"
        rows += [(i + n, f"{planted(rng, 40)} {text} {planted(rng, 40)}") for i, text in ((300, line), (400, common), (500, common))]
    for parts in (1, 5):
        got = {r["doc_id"]: r for r in passages.merged(passages.repeated(frame(spark, rows).repartition(parts))).collect()}
        assert set(got) == {i + n for n in range(12) for i in (200, 500)}
        assert all(got[i]["first_doc_id"] == i - 100 and got[i]["words"] == (51 if i < 300 else 56) for i in got)
