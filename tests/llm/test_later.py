"""Vector codes, SimHash classes, turn repair, runs of staged folders and the recall of seeds, against brute force."""

import hashlib
import itertools
import random
import re
import threading
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from siltstone.llm import common, decontaminate, quality, repeats, setjoin, simhash, turnrepair, veccodes

from .test_llm import ODD, SCHEMA, empty, odd, split

# --- 11


def brute_codes(rows, entries=veccodes.ENTRIES):
    """(ids in order, codes, errors, books) by comparing every part with every entry."""
    kept = [(i, [int(np.floor(np.float64(x) * 256)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    size = len(kept[0][1])
    cut = [k * size // 16 for k in range(17)]
    part = lambda v, k: v[cut[k] : cut[k + 1]]
    books = [[part(v, k) for _, v in kept[:entries]] for k in range(16)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: [min((far(part(v, k), e), j) for j, e in enumerate(books[k])) for k in range(16)]
    for _ in range(2):
        got = [nearest(v) for _, v in kept]
        for k in range(16):
            for j in range(len(books[k])):
                own = [part(v, k) for (_, v), g in zip(kept, got) if g[k][1] == j]
                if own:
                    books[k][j] = [sum(c) // len(own) for c in zip(*own)]
    got = [nearest(v) for _, v in kept]
    return [i for i, _ in kept], ["".join(f"{j:02x}" for _, j in g) for g in got], [sum(d for d, _ in g) for g in got], ",".join(str(x) for b in books for e in b for x in e)


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("seed,width,n", [(1, 64, 150), (2, 16, 90), (3, 20, 40), (4, 8, 70)])
def test_codes_equal_brute_force(spark, seed, width, n):
    """Small integers as components make many ties."""
    rng = random.Random(seed)
    rows = [(i, [rng.randrange(-3, 4) / 256 for _ in range(width)], None if i % 5 == 0 else i % 3) for i in range(n)]
    rows += [(n + 1, None, 1), (n + 2, [None] + [0.0] * (width - 1), 1), (n + 3, [float("nan")] * width, 1), (n + 4, [float("inf")] * width, 1), (n + 5, [0.0] * (width + 1), 1)]
    rng.shuffle(rows)
    got = {r.vec_id: r for r in veccodes.codes(spark.createDataFrame(rows, VECTORS).repartition(4)).collect()}
    ids, codes, errors, books = brute_codes([r[:2] for r in rows if r[0] != n + 5])
    assert sorted(got) == ids and [got[i].code for i in ids] == codes and [got[i].error for i in ids] == errors
    labels = {r[0]: r[2] for r in rows}
    for i in ids:
        assert got[i].label_error == sum(e for j, e in zip(ids, errors) if labels[j] == labels[i])
        assert got[i].codebooks_sha256 == hashlib.sha256(books.encode()).hexdigest()


def test_exponion_from_any_start():
    rng = np.random.default_rng(5)
    book = veccodes.Book(rng.integers(-4, 5, (64, 4)))
    x = rng.integers(-6, 7, (500, 4))
    far = ((x[:, None, :] - book.entries[None]) ** 2).sum(2)
    for start in (np.zeros(500, np.int64), rng.integers(0, 64, 500), far.argmax(1)):
        best, least = book.assign(x, start)
        assert (best == far.argmin(1)).all() and (least == far.min(1)).all()
    near = far.argmin(1)
    opened = (book.far[near] <= 4 * far.min(1)[:, None]).sum(1)
    assert opened.mean() < 40  # a good start leaves part of the list closed


def test_codes_odd(spark):
    make = lambda rows: veccodes.codes(spark.createDataFrame(rows, f"{VECTORS}, id long, code string").repartition(2)).collect()
    assert make([]) == [] and make([(1, None, 1, 1, "x")]) == []
    got = make([(1, [], 1, 1, "x")])
    assert [(r.vec_id, r.code, r.error) for r in got] == [(1, "00" * 16, 0)]
    got = make([(None, [1.0] * 64, None, 1, "x"), (2, [1e30] * 64, None, 1, "x"), (2, [1e30] * 64, 7, 1, "x")])
    assert sorted(r.error for r in got) == [0, 0, 0] and len({r.code for r in got}) == 2  # each row has its own entry, equal ones the lower index
    assert {r.vec_id for r in got} == {None, 2}


# --- 12


def brute_fingerprint(text, n=3):
    w = split(text)
    grams = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(values):
    """The index of the first that each reaches, over links of at most two bits."""
    up = list(range(len(values)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(values)), 2):
        if (values[i] ^ values[j]).bit_count() <= 2 and root(i) != root(j):
            up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(values))]


def test_fingerprints_equal_brute_force(spark, data):
    docs = pq.read_table(f"{data}/documents.parquet").to_pylist() + [{"doc_id": 10_000 + (i or 0) + 100 * k, "text": t} for k, (i, t) in enumerate(ODD)]
    got = {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.classes(spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], SCHEMA).repartition(3)).collect()}
    assert got == {d["doc_id"]: brute_fingerprint(d["text"]) for d in docs}


@pytest.mark.parametrize("hot", [0, 3, 10_000])
def test_links_equal_brute_force(spark, hot):
    """Chains, crowded halves and single bits apart, with every way of asking."""
    rng = random.Random(hot + 7)
    values = {rng.getrandbits(64) for _ in range(60)}
    for base in list(values)[:12]:
        x = base
        for _ in range(12):  # chains in either half, and members that differ in both
            for _ in range(rng.choice([1, 1, 2, 2, 3])):
                x ^= 1 << rng.randrange(64)
            values.add(x)
        values |= {base ^ (1 << a) ^ (1 << b) for a, b in ((0, 1), (0, 40), (33, 63), (31, 32))}
    crowd = rng.getrandbits(32) << 32
    values |= {crowd | rng.getrandbits(32) for _ in range(40)} | {0, 3, 1 << 63}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long").repartition(3), hot).collect()
    up = {v: v for v in signed}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for e in edges:
        assert ((e.u ^ e.v) & (1 << 64) - 1).bit_count() <= 2
        up[root(e.u)] = root(e.v)
    want = brute_classes(values)
    groups = {}
    for v, w in zip(signed, want):
        groups.setdefault(w, set()).add(root(v))
    assert all(len(g) == 1 for g in groups.values()) and len({root(v) for v in signed}) == len(groups)


def test_simhash_odd(spark):
    got = simhash.classes(odd(spark)).collect()
    assert len(got) == len(ODD)
    zero = {r.doc_id: r.component_id for r in got if r.fp == 0}
    assert {1, 2, 3} <= set(zero) and {zero[i] for i in (1, 2, 3)} == {1}
    assert [r.component_id for r in got if r.doc_id == 8] == [5, 5]  # "one two" again
    assert simhash.classes(empty(spark)).count() == 0


# --- 13


def brute_repair(turns):
    """(cost, audit, repaired) by trying all edits of turns (role, text, must_go, cut); insertions are tried too where turns are few."""
    best = None
    rows = len(turns)
    for edits in itertools.product("DKu a".replace(" ", ""), repeat=rows):
        for inserts in itertools.product([0, 1], repeat=rows + 1) if rows <= 4 else [(0,) * (rows + 1)]:
            cost, audit, out = 0, "", []
            for i in range(rows + 1):
                if inserts[i]:
                    cost, audit = cost + 5, audit + "I"
                    out.append(None)
                if i < rows:
                    role, text, must_go, cut = turns[i]
                    e = edits[i]
                    if e == "D":
                        cost, audit = cost + 2, audit + "D"
                    elif must_go:
                        break
                    else:
                        cost += (5 if cut else 0) + (e != "K")
                        audit += "K" if e == "K" else "R"
                        out.append((role, text) if e == "K" else ({"u": "user", "a": "assistant"}[e], text))
            else:
                options = [[x] if x else [("user", ""), ("assistant", "")] for x in out]
                for whole in itertools.product(*options):
                    if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in whole)):
                        best = min(best or (cost, audit, whole), (cost, audit, whole), key=lambda b: b[:2])
    return best


def faults(rows):
    """Rows (turn, role, text) in order, with what brute_repair wants, and the counts."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, out, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            n[fault] += 1
        out.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    turns = {t for t, _, _ in rows if t is not None}
    n["gaps"] = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    n["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return out, n


TURNS = "conv_id long, turn long, role string, text string"


def test_repairs_equal_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for c in range(120):
        for k in range(rng.randrange(1, 5 if c % 2 else 7)):
            rows.append((c, rng.choice([k, k, k + 2, None, 1]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", " "]), rng.choice(["Hi.", "No", " \t", "Yes! ", "", "a?", f"x{k}."])))
    got = {r.conv_id: r for r in turnrepair.repaired(spark.createDataFrame(rows, TURNS).repartition(5)).collect()}
    for c in range(120):
        turns, n = faults([r[1:] for r in rows if r[0] == c])
        cost, audit, whole = brute_repair(turns)
        r = got[c]
        assert (r.cost, r.audit) == (cost, audit) and [tuple(x) for x in r.repaired] == list(whole)
        assert {k: r[k] for k in n} == n


def test_long_conversation_in_chunks(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(1, k, rng.choice(["user", "assistant", "user", "system"]), rng.choice([f"t{k}.", f"t{k}", "again."])) for k in range(700)]
    df = spark.createDataFrame(rows, TURNS)
    got = []
    for chunk in (64, 5, 1000):
        monkeypatch.setattr(turnrepair, "CHUNK", chunk)
        got += [tuple(r) for r in turnrepair.repaired(df).collect()]
    assert len(set(map(str, got))) == 1 and len(got[0][7]) == 700 and "I" not in got[0][7]


def test_damage(spark, data):
    rows = pq.read_table(f"{data}/conversations.parquet").to_pylist() + [{"conv_id": None, "turn": k, "role": None, "text": None} for k in range(40)]
    rows += [{"conv_id": 10_000, "turn": None, "role": "user", "text": "A. b! c?"}]
    want = []
    for r in rows:
        f = lambda v: " " if v is None else str(v)
        rule = zlib.crc32(f"{f(r['conv_id'])}:{f(r['turn'])}".encode()) % 20
        role, text = f(r["role"]), f(r["text"])
        text = "" if rule == 1 else re.sub("[.!?]", "", text) if rule == 2 else text
        want += [(r["conv_id"], r["turn"], "user" if rule == 4 else role, text, rule != 0)] * (2 if rule == 3 else 1)
    df = spark.createDataFrame([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows], TURNS)
    assert sorted(map(str, (tuple(r) for r in turnrepair.damaged(df).collect()))) == sorted(map(str, want))


def test_repair_odd(spark):
    df = spark.createDataFrame([(None, None, None, None, 5), (None, 3, "user", "Hi.", 6), (7, 1, "user", "x.", 1), (7, 1, "user", "x.", 1)], f"{TURNS}, n int")
    got = {r.conv_id: r for r in turnrepair.repaired(df).collect()}
    assert got[None].audit == "DD" and got[None].gaps == 0 and got[None].blank == 1
    assert got[7].duplicate == 1 and got[7].audit == "DD" and got[7].repaired == []
    none = turnrepair.repaired(df.withColumn("kept", F.lit(False))).collect()
    assert {(r.cost, r.audit, len(r.repaired)) for r in none} == {(0, "", 0)} and len(none) == 2
    assert turnrepair.repaired(df.limit(0)).count() == 0


# --- runs


def test_runs_own_their_folders(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    made = [setjoin.jaccard_components(docs), repeats.digests(docs, ["doc_id"]), quality.judged(docs) if hasattr(quality, "judged") else quality.accepted(docs)]
    assert corpus_pipeline.run(spark, data).count() > 0
    assert all(df.count() > 0 for df in made)


def test_runs_of_two_threads(spark):
    inside, done, got = threading.Barrier(2), [], {}

    def work(name):
        with common.Run(spark) as run:
            df = common.staged(spark.range(20).toDF("x"), name)
            inside.wait(60)
            if name == "a":
                assert run.sweep() == 1
                done.append(1)
            inside.wait(60)
            if name == "b":
                got["b"] = df.count()
                common.discard(df)
                assert run.sweep() == 0

    threads = [threading.Thread(target=work, args=(x,)) for x in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert done == [1] and got == {"b": 20}


# --- 2


@pytest.mark.parametrize("share", [0.1, 0.2, 0.3])
def test_recall_of_seeds(spark, share):
    """Against full alignment: items under SHORT words exactly, longer ones to 0.9 at least, for each size of items."""
    rng = random.Random(int(share * 10))
    items, docs = [], []
    for size in (4, 6, 8, 12, 20, 40, 60):
        for k in range(24):
            item = [f"i{size}k{k}w{j}" if rng.random() < 0.7 else rng.choice("abcdefgh") for j in range(size)]
            body = [f"n{rng.randrange(10**6)}" if rng.random() < share else w for w in item]
            if k % 4 == 0:  # words put in between
                body = [x for w in body for x in ([w] if rng.random() < 0.8 else [w, "between"])]
            items.append(item)
            docs.append([rng.choice("abcdefgh") for _ in range(20)] + body + [rng.choice("abcdefgh") for _ in range(20)])
    hashed = lambda words: decontaminate.word_hashes(*common.as_bytes(pa.array([" ".join(words)])))[0]
    coded, wanted = [hashed(x) for x in items], {}
    for d, body in enumerate(map(hashed, docs)):
        for k, item in enumerate(coded):
            if 2 * int(np.isin(item, body).sum()) < len(item):
                continue
            score, _, _ = decontaminate.smith_waterman(item, body)
            if score >= decontaminate.SIMILAR * 2 * len(item):
                wanted[d, k] = score
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(docs)], SCHEMA)
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(df, bench).collect()}
    assert set(got) <= set(wanted)
    for size in (4, 6, 8, 12, 20, 40, 60):
        own = [x for x in wanted if len(items[x[1]]) == size]
        found = [x for x in own if x in got]
        assert own and (found == own and all(got[x] == wanted[x] for x in own) if size < decontaminate.SHORT else len(found) >= 0.9 * len(own))


@pytest.mark.parametrize("kind", ["smallint", "string"])
def test_item_ids_of_any_type(spark, kind):
    items = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e"), (None, "a b c d e")], "item_id long, text string").withColumn("item_id", F.col("item_id").cast(kind))
    docs = spark.createDataFrame([("x", "z a b c d e z")], "doc_id string, text string")
    got = decontaminate.leaks(docs, items)
    assert got.count() == 3 and dict(got.dtypes)["item_id"] == kind


def test_clean_decides_by_text(spark):
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    rows = [(1, "a one two three four five six b"), (1, "something else"), (None, "a one two three four five six b"), (None, "other"), (2, None), (2, None)]
    docs = spark.createDataFrame([(*r, "k", 1.0) for r in rows], f"{SCHEMA}, _key string, score double")
    got = sorted((str(r.doc_id), str(r.text)) for r in decontaminate.clean(docs, items).collect())
    assert got == sorted([("1", "something else"), ("None", "other"), ("2", "None"), ("2", "None")])
    assert decontaminate.clean(docs, items).columns == docs.columns
