"""Operators of the llm folder against brute force, round trips and held-out accuracy, with
nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from sidewise.llm import (
    encoding,
    entry,
    fingerprints,
    language_id,
    line_dedup,
    mixing,
    near_dedup,
    packing,
    substring_dedup,
    token_counts,
    token_files,
    top_k,
)

WORDS = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos int, key string, part int, h1 long, row string, copies int"


def rng_text(r, n, vocabulary=60):
    words = [f"w{r.randrange(vocabulary)}" for _ in range(n)]
    out, line = [], []
    for w in words:
        line.append(w)
        if r.random() < 0.1:
            out.append(" ".join(line))
            line = []
    return "\n".join([*out, " ".join(line)])


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    shared = "  This LINE is found in very many documents\t"
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [None, "", " \t\n ", "one", "one two", "ONE two", "é" * 50 + "\n" + shared]
    for k in range(12):
        texts.append(rng_text(r, 40 + k) + f"\n{shared}\n" + (passage if k % 3 == 0 else ""))
    base = rng_text(r, 120, 5000)
    texts += [base, base, base + " extra", base.upper(), base.replace("w1", "v1", 2)]
    texts += [rng_text(r, 12_000, 9000), "x" * 70_000, "a  b \r\n c\x1c d\n\n\ne ", "<|endoftext|> and <|startoftext|>"]
    out = []
    for i, t in enumerate(texts):
        source = [None, "a", "b", "c", "Ä"][i % 5]
        out.append((i * 3, t, "en", source, -1, 1, "k", 2, 3, "r", 9))
    out.append(out[10])  # a repeated row
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df, *keys):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- 1 ---------------------------------------------------------------------------------------
def test_fingerprints(spark, docs, rows, empty):
    found = fingerprints.edited_fingerprints(docs).collect()
    assert len(found) == len(rows)
    text = {i: t or "" for i, t, *_ in rows}
    ids = sorted(text, reverse=True)
    after = {i: ids[(k + 1) % len(ids)] for k, i in enumerate(ids)}
    prints = {}
    for r in found:
        t, k = text[r["doc_id"]], len(text[r["doc_id"]]) // 3
        edited = t[: len(t) - k] + text[after[r["doc_id"]]][:k]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if edited == t:
            assert r["fingerprint"] == r["edited_fingerprint"] and r["near_edited"] == 1
        prints.setdefault(t, set()).add(r["fingerprint"])
        prints.setdefault(edited, set()).add(r["edited_fingerprint"])
    assert all(len(x) == 1 for x in prints.values())
    assert len({next(iter(x)) for x in prints.values()}) == len({tuple(sorted(t.split("\n"))) for t in prints})
    long = [r for r in found if len(text[r["doc_id"]]) > 300 and len(set(text[r["doc_id"]])) > 5]
    assert sum(r["near_edited"] > r["near_next"] for r in long) >= 0.8 * len(long)
    assert fingerprints.edited_fingerprints(empty).count() == 0


def test_fingerprint_is_homomorphic(spark):
    paragraphs = ["first paragraph here", "a second one, longer than that", "third"]
    rows = [(0, "\n".join(paragraphs)), (1, "\n".join(reversed(paragraphs))), *[(2 + k, p) for k, p in enumerate(paragraphs)]]
    found = {r["doc_id"]: r for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[0]["exact"] == found[1]["exact"] and found[0]["lanes"] == found[1]["lanes"]
    added = [sum(found[2 + k]["exact"][i] for k in range(3)) % 2**32 for i in range(fingerprints.LANES32)]
    assert found[0]["exact"] == added
    assert found[0]["lanes"] == [sum(found[2 + k]["lanes"][i] for k in range(3)) for i in range(fingerprints.LANES16)]


def test_fingerprint_pieces_cover_paragraphs(spark):
    texts = ["That it.", "...", "One.\nTwo", "a sentence of more than sixteen characters! ok?\n\n.x", "é" * 19]
    for text in texts:
        assert "".join(re.findall(fingerprints.PIECE, text)) == text.replace("\n", "")
    rows = [(k, t) for k, t in enumerate([*texts, "That it.\nThat it.", "This is."])]
    found = [r["lanes"] for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert all(any(lanes) for lanes in found[: len(texts)])
    assert found[-2] == [2 * x for x in found[0]] and found[-1] != found[0]


def test_fingerprints_by_brute_force(spark, docs, rows):
    import struct

    import xxhash

    seeds = [xxhash.xxh64(struct.pack("<i", i), seed=42).intdigest() for i in range(fingerprints.LANES32 // 2)]

    def vectors(text):
        exact = [0] * fingerprints.LANES32
        for paragraph in text.split("\n"):
            for i, seed in enumerate(seeds):
                h = xxhash.xxh64(paragraph.encode(), seed=seed).intdigest()
                exact[2 * i] = (exact[2 * i] + (h & 0xFFFFFFFF)) % 2**32
                exact[2 * i + 1] = (exact[2 * i + 1] + (h >> 32)) % 2**32
        lanes = [0] * fingerprints.LANES16
        for piece in re.findall(fingerprints.PIECE, text):
            h = xxhash.xxh64(piece.encode(), seed=42).intdigest()
            h -= 2**64 * (h >> 63)
            code = h % (2 * fingerprints.LANES16)
            lanes[code // 2] += 1 if code % 2 == 0 else -1
        return exact, lanes

    def likeness(a, b):
        if a == b:
            return 1.0
        x, y = np.array(a[1], float), np.array(b[1], float)
        size = np.sqrt((x @ x) * (y @ y))
        return min(1.0, max(0.0, x @ y / size)) if size else 0.0

    text = {i: t or "" for i, t, *_ in rows}
    ids = sorted(text, reverse=True)
    after = {i: ids[(k + 1) % len(ids)] for k, i in enumerate(ids)}
    known = {i: vectors(t) for i, t in text.items()}
    for r in fingerprints.edited_fingerprints(docs).collect():
        i, t = r["doc_id"], text[r["doc_id"]]
        exact, lanes = known[i]
        assert r["fingerprint"] == "".join(f"{x:08x}" for x in exact) + "".join(f"{x % 65536:04x}" for x in lanes)
        k = len(t) // 3
        edited = vectors(t[: len(t) - k] + text[after[i]][:k])
        assert r["near_edited"] == pytest.approx(likeness(known[i], edited))
        assert r["near_next"] == pytest.approx(likeness(known[i], known[after[i]]))


# -- 2 ---------------------------------------------------------------------------------------
def greedy(vocabulary, word):
    s, n, i = token_counts.START + word, 0, 0
    while i < len(s):
        j = len(s)
        while j > i and s[i:j] not in vocabulary:
            j -= 1
        if j == i:
            return 1
        n, i = n + 1, j
    return n


def test_automaton_small_vocabularies():
    r = random.Random(3)
    for _ in range(200):
        vocabulary = {"▁"} if r.random() < 0.5 else {"▁a"}
        vocabulary |= {("▁" if r.random() < 0.3 else "") + "".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 25))}
        automaton = token_counts.Automaton(sorted(vocabulary))
        for _ in range(40):
            word = "".join(r.choice("abcd" if r.random() < 0.1 else "abc") for _ in range(r.randint(1, 12)))
            assert automaton.count(word) == greedy(vocabulary, word), (vocabulary, word)


def test_token_counts(spark, docs, rows, empty):
    vocabulary = set(token_counts.public_vocabulary())
    longest = max(map(len, vocabulary))

    def pieces(word):  # greedy, but looks no further than the longest piece
        s, n, i = token_counts.START + word, 0, 0
        while i < len(s):
            j = min(len(s), i + longest)
            while j > i and s[i:j] not in vocabulary:
                j -= 1
            if j == i:
                return 1
            n, i = n + 1, j
        return n

    want = sorted((i, len(WORDS.findall(t or "")), sum(map(pieces, WORDS.findall(t or "")))) for i, t, *_ in rows)
    assert sorted(tuple(r) for r in token_counts.count_tokens(docs).collect()) == want
    odd = [" a", "a \x1c b\x0b\x0cc\u00a0d", "\r\n", "e\tf  ", None]
    found = token_counts.count_tokens(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")).collect()
    assert [(r["n_words"], r["n_tokens"]) for r in sorted(found)] == [(len(w), sum(map(pieces, w))) for w in (WORDS.findall(t or "") for t in odd)]
    assert token_counts.count_tokens(empty).count() == 0


# -- 3 ---------------------------------------------------------------------------------------
@pytest.mark.parametrize(("name", "spaces"), [(token_files.TOKENIZER, "lead"), (packing.TOKENIZER, "drop")])
def test_slice_encoder(name, spaces, rows):
    enc = encoding.SliceEncoder(name, spaces)
    odd = ["", " ", "  a b  c ", "\n\n x\n", "don't I'll he's\t\tx \n y", "a <|endoftext|> b", "É café ß İ ΣΣ", "\x1c a\x1d \x85 b", "日本 語。 12 34x", " .,; ! a.b", "_ a1", "é ́x"]
    odd += ["a\tb  c", "\tq", "x\n\ny z", "\n", "a\n b"]
    texts = [*odd, None, *[t for _, t, *_ in rows]]
    many, offsets = enc.encode_many(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        want = np.array(enc.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()
        assert many[offsets[k] : offsets[k + 1]].tobytes() == want and enc.encode(t) == want, (t or "")[:40]
    assert [b - a for a, b in encoding.slices(pa.array(["ab", None, "c" * 100, "d"]), 50)] == [2, 1, 1]


def test_token_files(docs, rows, empty):
    files = token_files.write_tokens(docs)
    found = sorted((tuple(r) for r in token_files.token_digest(files).collect()), key=lambda r: (r[0], r[1]))
    enc = encoding.SliceEncoder(token_files.TOKENIZER, "lead").tokenizer
    want, start = [], 0
    for i, t in sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: r[0]):
        ids = [*enc.encode(t, add_special_tokens=False).ids, token_files.END_ID]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert found == want
    back = {r["doc_id"]: r["ids"] for r in files.collect()}
    for i, t, *_ in rows:
        assert back[i] == [*enc.encode(t or "", add_special_tokens=False).ids, token_files.END_ID]
    assert token_files.token_digest(token_files.write_tokens(empty)).count() == 0


def test_token_files_can_be_read_selectively(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    r = random.Random(1)
    texts = [" ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randrange(9)) for _ in range(300)) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    files = token_files.write_tokens(docs, row_group_bytes=64 << 10, page_bytes=4 << 10)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    enc = encoding.SliceEncoder(token_files.TOKENIZER, "lead").tokenizer
    ids = [[*enc.encode(t, add_special_tokens=False).ids, token_files.END_ID] for t in texts]
    groups = 0
    for f in glob.glob(f"{files._stored_in}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert all(c.has_offset_index and c.has_column_index for k, c in columns.items() if k != "ids.list.element")
            assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings)
            assert columns["doc_id"].encodings == ("DELTA_BINARY_PACKED",)
            assert meta.row_group(g).total_byte_size < 256 << 10
    assert groups >= 4

    def scanned(df):
        """Rows that the readers of the files gave."""
        df.collect()
        found, todo = 0, [df._jdf.queryExecution().executedPlan()]
        while todo:
            node = todo.pop()
            if "Scan" in node.nodeName() and node.metrics().contains("numOutputRows"):
                found += node.metrics().apply("numOutputRows").value()
            if node.nodeName().startswith("AdaptiveSparkPlan"):
                todo.append(node.executedPlan())
            todo += [node.children().apply(i) for i in range(node.children().length())]
            if "QueryStage" in node.nodeName():
                todo.append(node.plan())
        return found

    some = token_files.read_documents(files, 100, 109)
    assert {x["doc_id"]: x["ids"] for x in some.collect()} == {i: ids[i] for i in range(100, 110)}
    assert 10 <= scanned(some) < 150
    flat = [x for own in ids for x in own]
    for a, b in ((0, 5), (70_000, 73_210), (len(flat) - 3, len(flat)), (5, 5)):
        part = sorted((x["start"], x["ids"]) for x in token_files.read_positions(files, a, b).collect())
        assert [x for _, own in part for x in own] == flat[a:b]
        assert all(flat[s : s + len(own)] == own for s, own in part)


# -- 4 ---------------------------------------------------------------------------------------
def brute_lines(rows, min_docs=3, min_chars=20):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    where = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                where.setdefault(key(line), set()).add(i)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(where.get(key(x), ())) < min_docs or i == max(where[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup(docs, rows, empty):
    out = line_dedup.drop_shared_lines(docs)
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in out.collect()) == brute_lines(rows)
    assert out.first()["row"]["key"] == "k"
    assert line_dedup.drop_shared_lines(empty).count() == 0


def test_line_dedup_repeated_ids(spark):
    shared, own = "a line that many documents share", "a line that no other document holds"
    rows = [(1, f"{shared}\n{own}"), (1, f"{own} 2\n{shared}"), (2, shared), (3, shared), (None, shared)]
    found = line_dedup.drop_shared_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(1, 1, own), (1, 1, f"{own} 2"), (2, 1, ""), (3, 0, shared), (None, 0, shared)]
    assert sorted(((r["doc_id"], r["n_dropped"], r["kept"]) for r in found), key=str) == sorted(want, key=str)


# -- 5 ---------------------------------------------------------------------------------------
def test_packing(docs, rows, empty):
    found = packing.pack(docs).collect()
    enc = encoding.SliceEncoder(packing.TOKENIZER, "drop").tokenizer
    want, total = Counter(), 0
    for i, t, *_ in rows:
        ids = [*enc.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
        total += len(ids)
        for k, a in enumerate(range(0, len(ids), packing.CAPACITY)):
            part = ids[a : a + packing.CAPACITY]
            want[i, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    by = {}
    for r in found:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
    assert len(by) <= -(-total // packing.CAPACITY) + 1
    assert packing.pack(empty).count() == 0


def test_fill_plan_is_near_the_bound():
    r = random.Random(5)
    for n in (0, 1, 10, 1000, 5000):
        counts = Counter(min(2048, int(r.lognormvariate(6, 1)) + 1) for _ in range(n))
        plan = packing.fill_plan(counts)
        used, seen = Counter(), Counter()
        for length, first, times, each, seq, offset in plan.tolist():
            assert first == seen[length]
            seen[length] += times * each
            for s in range(times):
                used[seq + s] += each * length
        assert seen == counts and all(v <= 2048 for v in used.values())
        bound = max(-(-sum(k * v for k, v in counts.items()) // 2048), sum(v for k, v in counts.items() if k > 1024))
        assert len(used) <= bound * 1.01 + 1


def test_sums_have_every_filling():
    from itertools import combinations

    r = random.Random(1)
    for _ in range(150):
        capacity = r.randint(5, 40)
        index = packing.Sums(Counter(r.randint(1, capacity) for _ in range(r.randint(0, 30))), capacity)
        for _ in range(12):
            gap = r.randint(1, capacity)
            free = [x for x, n in enumerate(index.left) for _ in range(min(n, 3))]
            got = index.filling(gap)
            assert (got is not None) == any(sum(q) == gap for k in (1, 2, 3) for q in combinations(free, k))
            if got:
                assert sum(got) == gap and all(index.left[x] >= got.count(x) for x in got)
                index.take(got)


# -- 6 ---------------------------------------------------------------------------------------
def brute_repeats(rows, n=20):
    seen, out = set(), []
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        w = WORDS.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            x = tuple(w[k : k + n])
            if x in seen:
                gone[k : k + n] = [True] * n
            seen.add(x)
        out.append((i, len(w), sum(gone), " ".join(a for a, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


@pytest.mark.parametrize("size", [200, 1 << 22])
def test_substring_dedup(docs, rows, empty, size):
    unique = list({r[0]: r for r in rows}.values())
    once = docs.dropDuplicates(["doc_id"])
    found = sorted(tuple(r) for r in substring_dedup.remove_repeats(once, batch_bytes=size).collect())
    assert found == brute_repeats(unique)
    assert sum(r[2] for r in found) > 100
    again = substring_dedup.remove_repeats(docs, batch_bytes=size).collect()
    assert len(again) == len(rows)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_substring_dedup_within_a_document(spark):
    w = [f"a{i}" for i in range(25)]
    df = spark.createDataFrame([(1, " ".join(w + ["x"] + w)), (2, " ".join(w[3:])), (3, " ".join(w[:19]))], "doc_id long, text string")
    found = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(df).collect()}
    assert found == {1: 25, 2: 22, 3: 0}


# -- 7 ---------------------------------------------------------------------------------------
def test_targets():
    t = mixing.targets([100, 100, 100])
    assert t[0] == 200 and abs(t[1] - 2 * t[2]) < 1e-9 and abs(sum(t) - 450) < 1e-9
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]
    assert abs(sum(mixing.targets([5, 0, 7, 1000])) - 1518) < 1e-9


def test_choose_fits_budgets():
    r = random.Random(2)
    for _ in range(60):
        lengths = np.array(sorted({r.randint(0, 3000) for _ in range(r.randint(1, 40))}))
        counts = np.array([r.randint(1, 5) for _ in lengths])
        total = int((lengths * counts).sum())
        budget = r.randint(0, total)
        taken = mixing.choose(lengths, counts, budget)
        assert (taken >= 0).all() and (taken <= counts).all()
        assert abs(int((taken * lengths).sum()) - budget) <= lengths.max()


@pytest.mark.parametrize("limit", [4, 1 << 18])
def test_choose_is_nearest(monkeypatch, limit):
    monkeypatch.setattr(mixing, "LIMIT", limit)
    r = random.Random(5)
    for _ in range(100):
        lengths = sorted({r.randint(0, 60) * r.choice([1, 1, 2]) for _ in range(r.randint(1, 7))})
        counts = [r.randint(1, 3) for _ in lengths]
        sums = {0}
        for size, n in zip(lengths, counts, strict=True):
            sums = {x + k * size for x in sums for k in range(n + 1)}
        budget = r.randint(0, max(sums))
        taken = mixing.choose(np.array(lengths), np.array(counts), budget)
        assert abs(int((taken * lengths).sum()) - budget) == min(abs(x - budget) for x in sums)


def test_choose_beyond_five_hundred_lengths():
    lengths = np.arange(2, 4000, 2)
    counts = np.random.default_rng(1).integers(1, 400, len(lengths))
    budget = int((lengths * counts).sum() * 0.37) | 1
    assert abs(int((mixing.choose(lengths, counts, budget) * lengths).sum()) - budget) == 1


def test_mixing(docs, rows, empty):
    found = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))
    assert len(found) == len(rows)
    size, taken, target = Counter(), Counter(), {}
    for r in found:
        assert r["copies"] in (0, 1, 2) and r["taken"] == r["copies"] * r["size"]
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert sum(size.values()) == sum(len(WORDS.findall(t or "")) for _, t, *_ in rows)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    assert [target[s] for s in order] == pytest.approx(mixing.targets([size[s] for s in order]))
    for s in size:
        assert target[s] <= 2 * size[s] + 1e-6
        most = max(r["size"] for r in found if r["source"] == s)
        assert abs(taken[s] - target[s]) <= most
    assert mixing.mix(empty).count() == 0


# -- 8 ---------------------------------------------------------------------------------------
def brute_top(rows, step, k):
    fine = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, *_ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in fine:
        if i % step == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in fine if j != i and len(v) == len(q))[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(scored, 1)]
    return sorted(out)


def test_top_k(spark):
    r = np.random.default_rng(4)
    same = [0.5] * 20
    rows = [(i, (r.normal(size=20) * (1 + i % 7)).astype(np.float32).tolist(), "x", 1.0) for i in range(300)]
    rows += [(300 + i, same, "x", 1.0) for i in range(40)]
    rows += [(900, None, "x", 1.0), (950, [None] + same[1:], "x", 1.0), (1000, [float("nan")] + same[1:], "x", 1.0), (1050, [float("inf")] + same[1:], "x", 1.0), (1100, [0.0] * 20, "x", 1.0), (1150, [1.0, 2.0], "x", 1.0), (1151, [1.0, 1.0], "x", 1.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string, norm double")
    vectors = top_k.integer_vectors(df, "vec_id", "embedding")
    found = sorted(tuple(x) for x in top_k.top_k(vectors.where("vec_id % 50 = 0"), vectors).collect())
    assert found == brute_top(rows, 50, 5)
    none = vectors.where("vec_id < 0")
    assert top_k.top_k(none, none).count() == 0 and top_k.top_k(vectors.where("vec_id = 0"), none).count() == 0


def test_search_prunes_without_loss():
    r = np.random.default_rng(1)
    c, q = r.integers(-200, 200, (500, 64)), r.integers(-200, 200, (20, 64))
    ids = np.arange(500)
    full = q @ c.T
    floor = np.sort(full, axis=1)[:, -5].astype(float)
    for least in (0.0, 0.5, 2.0):  # all by coordinates, some, none
        top_k_least, top_k.COORDINATE_COSINE = top_k.COORDINATE_COSINE, least
        qi, ci, s = top_k.search(np.arange(1000, 1020), q, floor, ids, ids, c, 5)
        top_k.COORDINATE_COSINE = top_k_least
        for k in range(20):
            want = sorted((-x, i) for i, x in enumerate(full[k]))[:5]
            assert sorted((-int(x), int(i)) for a, i, x in zip(qi, ci, s, strict=True) if a == k) == want


def test_top_k_repeated_ids_and_large_values(spark):
    r = np.random.default_rng(8)
    rows = [(0, [1.0, 2.0]), (0, [2.0, 1.0]), (0, [1.0, 2.0]), (None, [1.0, 1.0]), (7, [0.0, 0.0])]
    vectors = top_k.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    found = top_k.top_k(vectors.where("vec_id = 0"), vectors, 2).collect()
    unit = 256 * 256
    assert sorted((x["rank"], x["vec_id"], x["score"] // unit) for x in found) == [(1, 0, 4), (1, 0, 5), (1, 0, 5), (2, 0, 4), (2, 0, 4), (2, 0, 4)]
    huge = [(i, [float(x) * 1e12 for x in r.integers(-9, 9, 3)]) for i in range(40)]
    vectors = top_k.integer_vectors(spark.createDataFrame(huge, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    found = top_k.top_k(vectors.where("vec_id % 10 = 0"), vectors, 3).collect()
    whole = {i: [int(256 * x) for x in v] for i, v in huge}
    for q in (0, 10, 20, 30):
        want = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:3]
        own = sorted((x["rank"], x["vec_id"], x["score"]) for x in found if x["query_id"] == q)
        assert own == [(n, i, min(max(-s, top_k.LEAST), top_k.MOST)) for n, (s, i) in enumerate(want, 1)]


def test_top_k_of_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(top_k, "BLOCK_ROWS", 16)
    monkeypatch.setattr(top_k, "QUERY_ROWS", 4)
    monkeypatch.setattr(top_k, "SPREAD", 2)
    r = np.random.default_rng(9)
    rows = [(i, (r.normal(size=24) * 2.0 ** r.integers(-6, 7)).astype(np.float32).tolist()) for i in range(700)]
    vectors = top_k.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    found = sorted(tuple(x) for x in top_k.top_k(vectors.where("vec_id % 50 = 0"), vectors).collect())
    assert found == brute_top(rows, 50, 5)


# -- 9 ---------------------------------------------------------------------------------------
def brute_near(rows):
    sets = {}
    for i, t, *_ in rows:
        w = WORDS.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    top = {i: i for i in sets}

    def of(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            same = len(sets[i] & sets[j])
            if sets[i] and 100 * same >= 75 * len(sets[i] | sets[j]) and sets[j]:
                a, b = sorted((of(i), of(j)))
                top[b] = a
    return sets, {i: of(i) for i in sets}


def test_near_duplicates(spark, docs, rows, empty):
    sets, component = brute_near(rows)
    want = sorted((i, len(sets[i]), component[i], component[i] == i) for i, *_ in rows)
    assert sorted(tuple(r) for r in near_dedup.near_duplicates(docs).collect()) == want
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_duplicates_chains(spark):
    """Texts that drift apart: links hold a component together whose ends are unlike."""
    r = random.Random(11)
    rows, words = [], [f"t{r.randrange(10**6)}" for _ in range(150)]
    for i in range(60):
        rows.append((i * 7 % 61, " ".join(words)))
        words = list(words)
        words[r.randrange(150)] = f"t{r.randrange(10**6)}"
    sets, component = brute_near(rows)
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == component


def test_estimate_is_corrected_for_chance(spark):
    r = np.random.default_rng(0)
    base = r.integers(1, 2**63, 2000, dtype=np.uint64)
    rows = []
    for k in (0, 500, 1000, 2000):
        other = np.concatenate([base[k:], r.integers(1, 2**63, k, dtype=np.uint64)])
        (_, a), (_, b) = (near_dedup.signature(near_dedup.minima(np.unique(x))[None]) for x in (base, other))
        rows.append((k, a[0].tolist(), b[0].tolist()))
    df = spark.createDataFrame(rows, "k long, a array<long>, b array<long>")
    for x in df.select("k", near_dedup.estimate("a", "b").alias("e")).collect():
        assert abs(x["e"] - (2000 - x["k"]) / (2000 + x["k"])) < 0.12


# -- 10 --------------------------------------------------------------------------------------
def test_forward_sums_all_segmentations():
    pieces = [bytes([b]) for b in range(256)] + [b" a", b"ab", b" ab", b"abc", b"bc"]
    table = language_id.Pieces(pieces)
    p = np.random.default_rng(3).random((len(pieces), 2))
    p /= p.sum(axis=0)

    def total(s, lang):
        if not s:
            return 1.0
        return sum(p[pieces.index(s[:k]), lang] * total(s[k:], lang) for k in range(1, len(s) + 1) if s[:k] in pieces)

    def total_log(s, lang):
        """The same sum by a table of logs, for long words."""
        logs = [0.0]
        for j in range(1, len(s) + 1):
            some = [logs[i] + np.log(p[pieces.index(s[i:j]), lang]) for i in range(max(0, j - 3), j) if s[i:j] in pieces]
            logs.append(max(some) + np.log(sum(np.exp(np.array(some) - max(some)))))
        return logs[-1]

    words = ["abc", "a", "cab", "abcabc", "é"]
    long = ["abc" * 20, "é" * 300, "ab" * 2000, "cabab" * 9]
    raw = np.frombuffer("".join(long).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in long])
    logs = language_id.log_words(table, p, raw, np.concatenate([[0], ends[:-1]]), ends)
    for w, row in zip(long, logs, strict=True):
        assert row.tolist() == pytest.approx([total_log(b" " + w.encode(), lang) for lang in range(2)])
    raw = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    logs = language_id.log_words(table, p, raw, np.concatenate([[0], ends[:-1]]), ends)
    for w, row in zip(words, logs, strict=True):
        for lang in range(2):
            assert row[lang] == pytest.approx(np.log(total(b" " + w.encode(), lang)))


def test_expected_counts_are_the_gradient():
    """Expected counts of pieces equal the slope of the log probability, also in long words."""
    pieces = [bytes([b]) for b in range(256)] + [b" a", b"ab", b" ab", b"abc", b"bc"]
    table, r = language_id.Pieces(pieces), np.random.default_rng(5)
    p = r.random((len(pieces), 1))
    p /= p.sum()
    words = ["abc" * 30, "a", "cab", "x" * 500, "abcab" * 200]
    raw = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts, weight = np.concatenate([[0], ends[:-1]]), r.random(len(words))
    found = language_id._expected(table, p[:, 0], language_id._matrix(raw, starts, ends), ends - starts + 1, weight)
    for k in (ord("x"), ord("a"), 256, 257, 258, 259, 260):
        logs = []
        for h in (1e-6, -1e-6):
            q = p.copy()
            q[k] *= 1 + h
            logs.append(language_id.log_words(table, q, raw, starts, ends)[:, 0])
        assert found[k] == pytest.approx(((logs[0] - logs[1]) / 2e-6 * weight).sum(), rel=1e-4)


def test_language_id_held_out(spark, sf_dir, empty):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.train(docs)
    out = language_id.predict(docs, model).join(docs.select("doc_id", "lang", language_id.held_out("doc_id").alias("h")), "doc_id").collect()
    held = [r for r in out if r["h"]]
    assert len(held) > 20 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    odd = spark.createDataFrame([(1, None, "q", True), (2, "", "q", False), (3, "123 !!", "q", True), (4, "a" * 5000, "q", True), (4, "le la " * 9000, "q", True)], "doc_id long, text string, score string, letters boolean")
    found = language_id.predict(odd, model).collect()
    assert [r["lang_pred"] for r in found[:3]] == ["und"] * 3 and [r["score"] for r in found[:3]] == [0.0] * 3
    assert all(0 <= r["score"] <= 1 for r in found) and found[4]["lang_pred"] == "fr"
    kept = language_id.keep_identified(odd, model)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {4}
    none = language_id.train(empty)
    assert language_id.predict(odd, none).where("lang_pred <> 'und'").count() == 0
    assert language_id.predict(empty, model).count() == 0


def test_language_id_sample_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_CHARS", 30_000)
    monkeypatch.setattr(language_id, "RUN_CHARS", 256, raising=False)
    schema, out = "doc_id long, text string, lang string", []
    for k in range(8):  # two long texts each: a share of 0.15, so whole documents are mostly not drawn
        own = [f"{chr(97 + k) * 2}{i}{chr(105 + k)}" for i in range(300)]
        r = random.Random(k)
        out += [(i, " ".join(r.choices(own, k=20_000))[:100_000], f"l{k}") for i in [j for j in range(9 * k, 9 * k + 9) if zlib.crc32(str(j).encode()) % 4 != 2][:2]]
    out += [(i, "solid" * 20_000, "solid") for i in (101, 102)]
    out += [(103, "rare word", "copies")] * 9000
    docs = spark.createDataFrame(out, schema)
    docs = docs.where(~language_id.held_out("doc_id"))
    sizes = Counter()
    for _, text, lang in docs.collect():
        sizes[lang] += len(text)
    model = language_id.train(docs)
    assert model.languages == sorted(sizes)
    parts = language_id.sample(docs.withColumnRenamed("doc_id", "id"), dict(sizes)).collect()
    drawn = Counter()
    for row in parts:
        drawn[row["lang"]] += len(row["part"])
    for lang in sizes.keys() - {"copies"}:
        assert 0.6 * 30_000 < drawn[lang] < 1.5 * 30_000
    known = {lang: {w for _, text, x in docs.where(f"lang = '{lang}'").collect() for w in text.split()} for lang in sizes if lang != "solid"}
    assert all(set(row["part"].split()) <= known[row["lang"]] for row in parts if row["lang"] != "solid")
    monkeypatch.setattr(language_id, "SAMPLE_CHARS", 10**9)  # everything: each character once
    for lang in sizes.keys() - {"copies"}:
        some = docs.where(f"lang = '{lang}'").withColumnRenamed("doc_id", "id")
        whole = Counter("".join(row["part"] for row in language_id.sample(some, dict(sizes)).collect()))
        assert whole - Counter({" ": whole[" "]}) == Counter(c for r in some.collect() for c in r["text"] if c != " ")


# -- pipeline and entry ----------------------------------------------------------------------
def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "source_mixing", "best_fit_packing"]
    one = stages["language_id"](spark, docs, sf_dir)
    assert one.columns == docs.columns
    gone = {r[0] for r in rows} - {r["doc_id"] for r in one.collect()}
    assert all(not re.search(r"[^\W\d_]", r[1] or "") for r in rows if r[0] in gone)
    two = stages["line_dedup"](spark, docs, sf_dir)
    assert two.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in two.collect()) == [(i, k) for i, _, _, k in brute_lines(rows)]
    assert two.where("n_chars <> char_length(text)").count() == 0
    three = stages["near_dedup"](spark, docs, sf_dir)
    _, component = brute_near(rows)
    assert three.columns == docs.columns
    assert sorted(r["doc_id"] for r in three.collect()) == sorted({component[i] for i in component})
    four = stages["source_mixing"](spark, docs, sf_dir)
    assert four.columns == docs.columns
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    assert Counter(r["doc_id"] for r in four.collect()) == Counter({i: n for i, n in copies.items() if n})
    five = stages["best_fit_packing"](spark, four, sf_dir)
    assert five.where("piece = 0").count() == four.count()


def odd_documents():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and columns
    whose names the stages use themselves."""
    copy = " ".join(f"le mot{i} de la maison" for i in range(30))
    shared = "une ligne que beaucoup de documents ont en commun"
    texts = [None, "", " \n\t", "123 !?", copy, copy, copy + "\n" + shared, "la rue\n" + shared, "le jour\n" + shared, "le la les " * 9000, "x" * 30_000]
    rows = [(i, t, [None, "fr"][i % 2], [None, "a", "b"][i % 3], len(t or ""), "r", 1, "k", 2, 3) for i, t in enumerate(texts)]
    rows += [rows[4], rows[7], (None, copy, "fr", "a", None, None, None, None, None, None)]
    return rows, "doc_id long, text string, lang string, source string, n_chars long, row string, copies int, kept string, head long, pos int"


def test_pipeline_stages_on_odd_tables(spark, sf_dir):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    odd, schema = odd_documents()
    odd, none = spark.createDataFrame(odd, schema), spark.createDataFrame([], schema)
    rows = [tuple(r) for r in odd.collect()]
    for name in list(stages)[:-1]:
        assert stages[name](spark, none, sf_dir).count() == 0
        assert stages[name](spark, odd, sf_dir).columns == odd.columns
    assert stages["best_fit_packing"](spark, none, sf_dir).count() == 0
    assert {r["doc_id"] for r in stages["language_id"](spark, odd, sf_dir).collect()} >= {4, 5, 6, 7, 8, 9, None}
    lines = stages["line_dedup"](spark, odd, sf_dir).collect()
    want = [(i, k) for i, _, _, k in brute_lines([r for r in rows if r[0] is not None])]
    assert sorted(((r["doc_id"], r["text"]) for r in lines if r["doc_id"] is not None)) == sorted(want)
    assert [r["text"] for r in lines if r["doc_id"] is None] == [rows[-1][1]]
    assert all(r["row"] in ("r", None) and r["pos"] in (3, None) for r in lines)
    _, component = brute_near([r for r in rows if r[0] is not None])
    near = Counter(r["doc_id"] for r in stages["near_dedup"](spark, odd, sf_dir).collect())
    assert near == Counter(r[0] for r in rows if r[0] is None or component[r[0]] == r[0])
    taken = {(r["doc_id"], r["size"]): r["copies"] for r in mixing.mix(odd).collect()}
    mixed = Counter(r["doc_id"] for r in stages["source_mixing"](spark, odd, sf_dir).collect())
    each = Counter(r[0] for r in rows)
    most = {i: max(n for (j, _), n in taken.items() if j == i) for i in each}
    assert mixed == Counter({i: each[i] * most[i] for i in each if most[i]})
    packed = stages["best_fit_packing"](spark, odd, sf_dir)
    assert packed.where("piece = 0").count() == len(rows)


def test_near_duplicates_recall_at_the_threshold():
    """Thousands of pairs of likeness 0.75 to 0.80: bands find all but a few in a million, and
    estimates fall below the bound for a few in ten thousand."""
    r = np.random.default_rng(77)
    n, missed_bands, missed_estimate = 3000, 0, 0
    for _ in range(n):
        same = int(r.integers(75, 81))
        size = int(r.integers(3, 12)) * 100
        both = r.integers(0, 2**63, size * same // 100, dtype=np.uint64)
        rest = r.integers(0, 2**63, size - len(both), dtype=np.uint64)
        half = len(rest) // 2
        one, two = (np.unique(np.concatenate([both, x])) for x in (rest[:half], rest[half:]))
        (bands, other), planes = near_dedup.signature(np.stack([near_dedup.minima(one), near_dedup.minima(two)]))
        missed_bands += not (bands == other).any()
        x = planes.view(np.uint64).reshape(2, near_dedup.BITS, -1)
        differ = np.bitwise_count(np.bitwise_or.reduce(x[0] ^ x[1], axis=0)).sum()
        likeness = (1 - differ / near_dedup.HASHES - 0.25) / 0.75
        missed_estimate += likeness < near_dedup.LEAST_ESTIMATE
    assert missed_bands == 0 and missed_estimate <= 3


def test_words_hash_apart():
    """Words that polynomial hashes modulo a power of two can't tell apart."""
    from sidewise.llm import hashing

    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    texts = [word, word.translate(str.maketrans("ab", "ba")), "x" * 64 + "y" * 64, "y" * 64 + "x" * 64, "ab", "ba", "a", "b"]
    raw, offsets = hashing.buffers(pa.array([" ".join(texts)]))
    starts, ends, _ = hashing.word_bounds(raw, offsets)
    assert len(set(hashing.hash_words(raw, starts, ends).tolist())) == len(texts)


def test_null_ids(spark, sf_dir):
    import corpus_pipeline

    copy = " ".join(f"the word number{i}" for i in range(50))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, copy, "en", "a", len(copy)), (None, "another short text", "en", "a", 18), (1, copy, "en", "a", len(copy)), (2, copy, "en", "b", len(copy))]
    docs = spark.createDataFrame(rows, schema)
    near = near_dedup.near_duplicates(docs).collect()
    assert sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near), key=str) == sorted(
        [(None, None, True)] * 2 + [(1, 1, True), (2, 1, False)], key=str
    )
    assert sorted(r["n_shingles"] for r in near if r["doc_id"] is None) == [1, 146]
    prints = fingerprints.edited_fingerprints(docs).collect()
    assert len(prints) == 4 and sum(r["doc_id"] is None for r in prints) == 2
    k = len("another short text") // 3
    edited = "another short text"[: 18 - k] + "another short text"[:k]
    assert hashlib.sha256(edited.encode()).hexdigest() in {r["edited_sha256"] for r in prints if r["doc_id"] is None}
    stages = dict(corpus_pipeline.STAGES)
    for name in ("language_id", "line_dedup", "near_dedup"):
        some = spark.read.parquet(f"{sf_dir}/documents.parquet").select(docs.columns).union(docs) if name == "language_id" else docs
        assert stages[name](spark, some, sf_dir).where("doc_id is null").count() == 2
    copies = mixing.mix(docs).where("doc_id is null").selectExpr("max(copies) c").first()["c"]
    assert stages["source_mixing"](spark, docs, sf_dir).where("doc_id is null").count() == 2 * copies > 0
    packed = stages["best_fit_packing"](spark, docs, sf_dir).where("piece = 0")
    assert packed.where("doc_id is null").count() == 2


def test_run(spark, sf_dir):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf_dir)
    assert out.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


@pytest.mark.parametrize("name", [*sorted(entry.ORACLE_SQL), "op2_token_counts"])
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    want = con.sql(entry.oracle_sql()[name])
    found = entry.QUERIES[name](spark, sf_dir).select(*want.columns)
    assert got(found) == sorted(want.fetchall(), key=repr)


def test_queries_are_complete():
    assert [min(k for k in entry.QUERIES if k.startswith(f"op{n}_")) for n in range(1, 11)]
