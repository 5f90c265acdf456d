import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueloom.llm import linking as L
from cueloom.llm.common import cut
from cueloom.llm.components import connected_components
from cueloom.llm.line_dedup import drop_duplicate_lines, line_components, lines_of, normalised_lines
from cueloom.llm.near_duplicates import CHUNK, MAX_DISTANCE, SYMBOLS, keep_representatives, near_duplicates
from tests.llm import fixtures as X


def brute(sets, percent=80):
    """Smallest key reachable over all pairs at the similarity or above."""
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having = defaultdict(list)
    for i in sorted(sets):
        seen = Counter()
        for g in sets[i]:
            seen.update(having[g])
            having[g].append(i)
        for j, n in seen.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, size):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    n = min(size, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(spark, size):
    given = X.rows()
    got = near_duplicates(X.clashing(X.documents(spark)), size).collect()
    want = brute({i: s for i, t in given if (s := shingles(t, size))})
    assert len(got) == len(given)
    texts = dict(given)
    for r in got:
        assert r.n_shingles == len(shingles(texts[r.doc_id], size))
        assert r.component_id == want.get(r.doc_id, r.doc_id)
        assert r.kept == (r.doc_id == r.component_id)


def test_near_copies_of_all_degrees(spark):
    """A family that mutates step by step: links chain through hubs and across them."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(120)]
    given = []
    for k in range(150):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 12])):
            words[rng.randrange(len(words))] = f"m{rng.randrange(10_000)}"
        given.append((k, " ".join(words)))
    given += [(1000 + k, X.prose(rng, 50)) for k in range(50)]
    got = {r.doc_id: r.component_id for r in near_duplicates(X.documents(spark, given), 2).collect()}
    assert got == brute({i: shingles(t, 2) for i, t in given})


def test_pigeonhole_keys_find_all_pairs_under_the_distance():
    rng = np.random.default_rng(0)
    masks = L.chunk_masks(SYMBOLS, CHUNK, MAX_DISTANCE)
    for _ in range(200):
        a = rng.integers(0, 2**16, (1, SYMBOLS), dtype=np.uint16)
        b = a.copy()
        at = rng.choice(SYMBOLS, MAX_DISTANCE, replace=False)
        b[0, at] ^= 1
        assert np.intersect1d(L.keys_of(a, masks), L.keys_of(b, masks)).size
    with pytest.raises(ValueError):
        L.chunk_masks(10, 5, 20)


def test_signatures_of_lines_and_sets_agree():
    rng = random.Random(2)
    lines = [bytes(rng.choices(b"abc de", k=rng.randint(1, 400))) for _ in range(200)] + [b"x", b"12345678", b"y" * 100_000]
    assert (L.byte_signatures(lines, 16) == L.signatures([L.byte_shingles(x) for x in lines], 16)).all()
    a, b = L.byte_shingles(lines[0] * 3), L.byte_shingles(lines[0] * 3 + b"!")
    s = L.signatures([a, b, np.empty(0, dtype=np.uint64)], 48)
    assert (s[0] == s[1]).mean() > 0.7 and not s[2].any()


def test_exact_links_in_and_between_blocks():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    sets = [np.unique(np.append(base[: rng.integers(120, 200)], rng.integers(0, 2**63, rng.integers(0, 30), dtype=np.uint64))) for _ in range(60)]
    node, block = np.arange(60), np.arange(60) % 3
    links = []
    for i in range(3):
        for j in range(i, 3):
            at = np.flatnonzero((block == i) | (block == j))
            links += L.exact_links(node[at], block[at], [sets[k] for k in at], L.LinkSpec(bytes, 80, 30))
    want = brute({k: s.tolist() for k, s in enumerate(sets)})
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert {k: find(k) for k in range(60)} == want


def test_components(spark):
    rng = random.Random(1)
    for n, m in ((60, 30), (60, 80)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(100, 160)]
        sets = defaultdict(set)
        for k, (a, b) in enumerate(edges):
            if a != b:
                sets[a].add(k)
                sets[b].add(k)
        got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
        parent = {}

        def find(x):
            parent.setdefault(x, x)
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            if a != b:
                a, b = find(a), find(b)
                parent[max(a, b)] = min(a, b)
        assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_bitmap_lets_members_through(spark):
    df = spark.createDataFrame([(k * 7919 - 50_000,) for k in range(100)], "h bigint")
    bitmap = L.membership_bitmap(df)
    assert L.may_be_member(bitmap, np.array([r.h for r in df.collect()])).all()
    assert L.may_be_member(bitmap, np.arange(10**6, 10**6 + 1000)).sum() < 5


def test_buckets_over_batches(spark):
    rows = [(k % 7, v) for k in range(70) for v in (k, k)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = sorted((r.key, r.hub, r.node) for r in L.buckets(spark.createDataFrame(rows, "key bigint, node bigint")).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted((k, k, n) for k in range(7) for n in range(k + 7, 70, 7))


def char_runs(line):
    return {line[k : k + 5] for k in range(max(1, len(line) - 4))}


def expected_lines(given):
    import re

    first, at = {}, {}
    for i, t in sorted((i, t) for i, t in given if t):
        for n, raw in enumerate(t.split("\n")):
            line = " ".join(re.findall(r"[^\x20\x09-\x0D]+", lower(raw)))
            if line:
                first.setdefault(line, (i, n))
                first[line] = min(first[line], (i, n))
                at[i, n] = line
    root = brute({p: char_runs(line) for line, p in first.items()})
    return {p: root[first[line]] for p, line in at.items()}


def test_lines_equal_brute_force(spark):
    given = [r for r in X.rows()]
    rng = random.Random(6)
    line = "this is a line of some length that many documents have with small changes in it"
    given += [(500 + k, line[: rng.randrange(len(line))] + rng.choice("abc") + line[rng.randrange(40, len(line)) :] + "\n" + X.prose(rng, 12)) for k in range(30)]
    got = line_components(X.clashing(X.documents(spark, given))).collect()
    want = expected_lines(given)
    assert {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no) for r in got} == want
    assert all(r.kept == ((r.doc_id, r.line_no) == (r.first_doc_id, r.first_line_no)) for r in got)
    assert normalised_lines(b" A\tB  c\r\n\n x") == [(0, b"a b c"), (2, b"x")]


def test_dropped_lines(spark):
    given = X.rows()
    docs = X.clashing(X.documents(spark))
    got = drop_duplicate_lines(docs)
    assert got.columns == docs.columns
    keep = {p for p, q in expected_lines(given).items() if p == q}
    want = {}
    for i, t in given:
        lines = (t or "").split("\n")
        left = [x for n, x in enumerate(lines) if not x.strip() or (i, n) in keep]
        if t is None or not t.strip() or any(x.strip() for x in left):
            want[i] = None if t is None else "\n".join(left)
    assert {r.doc_id: r.text for r in got.select("doc_id", "text").collect()} == want


def test_representatives(spark):
    docs = X.clashing(X.documents(spark))
    kept = {r.doc_id for r in near_duplicates(docs, 5).where("kept").collect()}
    got = keep_representatives(docs)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == kept
    assert {3, 200, 201, 203}.issubset(kept) and not {100, 101, 102, 204} & kept


def test_sketches_and_leaders(spark):
    """Leaders connect all rows of a bucket that are under the distance, over batches of any size."""
    rng = np.random.default_rng(3)
    rows = []
    for key in range(40):
        for _ in range(rng.integers(1, 5)):
            word = int(rng.integers(-(2**63), 2**63))
            for _ in range(rng.integers(1, 25)):
                far = word
                for bit in rng.choice(63, rng.integers(0, 13), replace=False):
                    far ^= 1 << int(bit)
                rows.append((key, len(rows), far))
    rows += rows[::3]
    for size in (2, 7, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = L.sketch_links(spark.createDataFrame(rows, "key bigint, node bigint, sketch bigint")).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        parent = list(range(len(rows)))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for r in got:
            parent[find(r.a)] = find(r.b)
        by = defaultdict(list)
        for k, n, s in rows:
            by[k].append((n, s))
        for own in by.values():
            for n, s in own:
                for m, t in own:
                    if ((s ^ t) & (2**64 - 1)).bit_count() <= L.SKETCH_DISTANCE:
                        assert find(n) == find(m)
        assert len(got) < 3 * len(rows) and all(rows[r.a][0] == rows[r.b][0] == r.key and (rows[r.a][2], rows[r.b][2]) == (r.sketch_a, r.sketch_b) for r in got)


def test_packed_cells(spark, monkeypatch):
    """Bucket rows travel packed, 20 bytes each, and a cell too large to hold gives the same links by its leaders."""
    rng = np.random.default_rng(4)
    rows = []
    for key in rng.integers(-(2**63), 2**63 - 1, 60).tolist():
        for _ in range(rng.integers(1, 4)):
            word = int(rng.integers(-(2**63), 2**63 - 1))
            for spread in rng.integers(0, 13, rng.integers(1, 9)):
                far = word
                for bit in rng.choice(63, spread, replace=False):
                    far ^= 1 << int(bit)
                rows.append((key, len(rows), far))
    keys, nodes, words = (np.array(x) for x in zip(*rows, strict=True))
    monkeypatch.setattr(L, "PACK_ROWS", 100)
    packed = list(L.packed_cells([(keys[:170], nodes[:170], words[:170]), (keys[170:], nodes[170:], words[170:])], 4096))
    assert len(packed) > 2 and sum(len(x) for b in packed for x in b.column(1).to_pylist()) == 20 * len(rows)
    assert all(b.num_rows == len(set(b.column(0).to_pylist())) for b in packed)
    back = set()
    for b in packed:
        for cell, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            back |= {(int(k), cell, int(n), int(w)) for k, n, w in np.frombuffer(data, L._ROW)}
    assert back == {((k & (2**64 - 1)) >> 32, k & 4095, n, w & (2**64 - 1)) for k, n, w in rows}

    distance = lambda a, b: ((rows[a][2] ^ rows[b][2]) & (2**64 - 1)).bit_count()
    for most in (4_000_000, 3):
        monkeypatch.setattr(L, "CELL_ROWS", most)
        got = L.sketch_links(spark.createDataFrame(rows + rows[::2], "key bigint, node bigint, sketch bigint")).collect()
        parent = list(range(len(rows)))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for r in got:
            assert r.a != r.b and rows[r.a][0] == rows[r.b][0]
            parent[find(r.a)] = find(r.b)
        assert all(find(a) == find(b) for a in range(len(rows)) for b in range(max(0, a - 30), a) if rows[a][0] == rows[b][0] and distance(a, b) <= L.SKETCH_DISTANCE)
        beyond = {r.key for r in got if distance(r.a, r.b) > L.SKETCH_CLOSE}
        marked = {r.key for r in got if r.far}
        assert beyond <= marked and beyond
        if most > len(rows):
            assert marked == beyond and len(marked) < len({r.key for r in got})


def test_large_components_over_many_blocks(spark, monkeypatch):
    """Blocks with pivots, then what is left apart against all: as brute force has it."""
    monkeypatch.setattr(L, "BLOCK_LEAST", 2_000)
    monkeypatch.setattr(L, "BLOCK_MOST", 3_000)
    monkeypatch.setattr(L, "PIVOTS", 3)
    rng = random.Random(21)
    texts = {}
    for family in range(3):
        base = [f"w{family}x{k}" for k in range(60)]
        for _ in range(60):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 5, 6, 9])):
                words[rng.randrange(len(words))] = f"m{rng.randrange(50)}"
            texts[len(texts)] = " ".join(words)
    coarse = spark.createDataFrame([(k, 0) for k in texts], "node bigint, root bigint")
    sizes = spark.createDataFrame([(k, len(shingles(t, 2))) for k, t in texts.items()], "node bigint, n bigint")
    packed = spark.createDataFrame([(k, t.encode()) for k, t in texts.items()], "node bigint, z binary")
    spec = L.LinkSpec(lambda t: L.word_shingles(t, 2), 80, 30, 80, bytes)
    got = {r.node: r.root for r in L.confirmed_components(coarse, sizes, packed, spec).collect()}
    want = brute({k: shingles(t, 2) for k, t in texts.items()})
    assert {k: got.get(k, k) for k in texts} == want and len(set(want.values())) > 20


def test_null_ids_and_repeated_ids(spark):
    """Null ids are one id; of a repeated id with other texts each line is judged by itself."""
    given = [(None, "one line that two rows of no id have here"), (1, "one line that two rows of no id have here\nand one of its own to keep"), (5, "first text of five"), (5, "other text under the same id\nfirst text of five")]
    got = [tuple(r) for r in drop_duplicate_lines(X.documents(spark, given)).select("doc_id", "text").collect()]
    assert sorted(got, key=str) == sorted([given[0], (1, "and one of its own to keep"), given[2], (5, "other text under the same id")], key=str)
    assert {(r.doc_id, r.line_no): r.kept for r in line_components(X.documents(spark, given[:2])).collect()} == {(None, 0): True, (1, 0): False, (1, 1): True}


def test_heavy_lines(spark):
    given = [(k, f"shared by all of them\n{'abcdefghijklmnopqrstuvwxyz'[k % 26] * 40}{k}") for k in range(1200)]
    got = line_components(X.documents(spark, given)).where("line_no = 0").collect()
    assert len(got) == 1200 and sum(r.kept for r in got) == 1 and {r.first_doc_id for r in got} == {0}


def test_empty_tables(spark):
    e = X.empty(spark)
    assert near_duplicates(e).count() == 0 and line_components(e).count() == 0
    assert drop_duplicate_lines(e).count() == 0 and keep_representatives(e).count() == 0


def test_checkpoint_folder_is_that_of_the_session(spark):
    assert cut(spark.range(3)).count() == 3
    assert spark.sparkContext.getCheckpointDir()


def test_lines_are_sets_of_five_code_points(spark):
    """Brute force over runs of 5 code points; small edits of short lines and of other scripts link."""
    rng = random.Random(9)
    scripts = ["abcdefghijklmnopqrstuvwxyz ", "абвгдежзийклмнопрстуфхцчшщыьэюя ", "あいうえおかきくけこさしすせそたちつてと漢字", "aéßüñoçêiuä "]
    given = []
    for k in range(60):
        line = "".join(rng.choice(scripts[k % 4]) for _ in range(rng.randint(50, 90))).strip()
        cut_at = rng.randint(10, len(line) - 10)
        given += [(2 * k, line), (2 * k + 1, line[:cut_at] + "x" + line[cut_at + 1 :])]
    got = line_components(X.documents(spark, given)).collect()
    first = {" ".join(t.split()): (i, 0) for i, t in reversed(given)}
    root = brute({p: char_runs(line) for line, p in first.items()})
    assert {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no) for r in got} == {(i, 0): root[first[" ".join(t.split())]] for i, t in given}
    assert sum(not r.kept for r in got) > 40


def test_shingles_are_one_for_each_run_of_code_points():
    lines = ["abcdé fghij", "xabcdé", "漢字かな交じり文", "🙂🙂🙃🙂🙂🙂", "abc", "é", "plain ascii line"]
    for x in lines:
        assert len(L.byte_shingles(x.encode())) == len(char_runs(x))
    for x in lines:
        for y in lines:
            both = np.intersect1d(L.byte_shingles(x.encode()), L.byte_shingles(y.encode()))
            assert len(both) == len(char_runs(x) & char_runs(y))
    raw = [x.encode() for x in lines]
    assert (L.byte_signatures(raw, 16) == L.signatures([L.byte_shingles(x) for x in raw], 16)).all()


def test_lines_of_many_texts():
    given = [b"One  two\n\n three\t", None, b"", b"plain\nlines", b"\r\n x\x0b\x0cy \n\n", b" \n ", "É  ß\nß".encode(), b"end "]
    of, number, lines = lines_of(given)
    assert list(zip(of.tolist(), number.tolist(), lines, strict=True)) == [
        (0, 0, b"one two"),
        (0, 2, b"three"),
        (3, 0, b"plain"),
        (3, 1, b"lines"),
        (4, 1, b"x y"),
        (6, 0, "É ß".encode()),
        (6, 1, "ß".encode()),
        (7, 0, b"end"),
    ]
    assert [normalised_lines(t) for t in given] == [[(n, x) for k, n, x in zip(of.tolist(), number.tolist(), lines, strict=True) if k == i] for i in range(len(given))]


def test_shingles_of_many_texts_are_those_of_each():
    rng = random.Random(12)
    texts = ["".join(rng.choices("abcé漢 \0😀", k=rng.randint(0, 60))).encode() for _ in range(500)] + [b"", b"x", b"abc\xff\xe2\x82 broken \x80 utf", b"y" * 300_000, "é".encode() * 100_000]
    for a, b in zip(L.byte_shingle_sets(texts), map(L.byte_shingles, texts), strict=True):
        assert a.tolist() == b.tolist()
    full = [t for t in texts if t]
    assert (L.byte_signatures(full, 16) == L.signatures([L.byte_shingles(t) for t in full], 16)).all()


def test_small_buckets_are_connected_together(monkeypatch):
    """Buckets of up to 128 rows are not fed to leaders row by row; close pairs connect what they can, and only then far ones."""
    monkeypatch.setattr(L._Leaders, "feed", None)
    rng = np.random.default_rng(3)
    key, sketch = [], []
    for k, m in enumerate([1, 2, 3, 5, 9, 40, 128] * 12):
        base = rng.integers(0, 2**63, 3, dtype=np.uint64)[rng.integers(0, 3, m)]
        for _ in range(k % 14):  # up to 26 bits between two of a family
            base ^= np.uint64(1) << rng.integers(0, 64, m).astype(np.uint64)
        key += [k] * m
        sketch += base.tolist()
    key, sketch = np.array(key, dtype=np.uint64), np.array(sketch, dtype=np.uint64)
    at = rng.permutation(len(key))
    got = L._bucket_pairs(key[at], at.astype(np.int64), sketch[at]).to_pydict()
    pairs = defaultdict(list)
    for k, a, b, far in zip(got["key"], got["a"], got["b"], got["far"], strict=True):
        assert key[a] == key[b] == k
        pairs[k].append((a, b, far))
    for k in range(int(key.max()) + 1):
        own = np.flatnonzero(key == k)
        d = np.bitwise_count(sketch[own][:, None] ^ sketch[own])
        assert len(pairs[k]) < len(own) and all(np.bitwise_count(sketch[a] ^ sketch[b]) <= L.SKETCH_DISTANCE for a, b, _ in pairs[k])

        def parts(links):
            label = {int(x): int(x) for x in own}
            for a, b in links:
                a, b = label[int(a)], label[int(b)]
                label = {x: min(a, b) if y in (a, b) else y for x, y in label.items()}
            return label

        assert parts([x[:2] for x in pairs[k]]) == parts(own[np.argwhere(d <= L.SKETCH_DISTANCE)])
        if not any(far for *_, far in pairs[k]):  # then close pairs alone connect it
            assert parts([x[:2] for x in pairs[k]]) == parts(own[np.argwhere(d <= L.SKETCH_CLOSE)])


def test_lines_of_many_and_of_few_documents(spark):
    """A line of all documents, lines of two, near copies and lines of their own, over more occurrences than are joined apart."""
    rng = random.Random(13)
    given = []
    for k in range(700):
        pair, near = random.Random(k // 2), X.prose(random.Random(10_000 + k // 7), 25)
        given.append((k, "\n".join(["a line that all of the documents have in common", X.prose(pair, 12), near + rng.choice(["", " x", " yz"]), X.prose(rng, 12), X.prose(rng, 3)])))
    docs = X.documents(spark, given)
    want = expected_lines(given)
    got = line_components(docs).collect()
    assert len(got) == len(want) == 3500
    assert {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no) for r in got} == want
    named = line_components(docs.withColumn("doc_id", F.lpad(F.col("doc_id").cast("string"), 4, "0"))).collect()
    assert {(int(r.doc_id), r.line_no): (int(r.first_doc_id), r.first_line_no) for r in named} == want
