"""Conversation repair, ORC token files and the filter audit against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import conversation_repair as C
from skein.llm import filter_audit as A
from skein.llm import orc_tokens as O
from skein.llm import registry

# ---- conversations


def key(x):
    return " " if x is None else str(x)


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{key(conv)}:{key(turn)}".encode()) % 20
        role, text = key(role), key(text)
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def brute_repair(rows):
    """rows: (role, text, forced, truncated). The least (cost, letters) over all edits, and the turns they make."""

    @lru_cache(None)
    def best(at, made, inserted):
        # made: the last two initials; what precedes them was legal
        out = []
        if at == len(rows) and made[-1:] in ("", "a"):
            out.append((0, "", ()))
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[made[-1:]]
        if inserted < 3:
            for role in ("user", "assistant"):
                if role[0] in follows:
                    c, a, t = best(at, role[0], inserted + 1)
                    out.append((c + 5, "I" + a, ((role, ""), *t)))
        if at < len(rows):
            role, text, forced, truncated = rows[at]
            c, a, t = best(at + 1, made, 0)
            out.append((c + 2, "D" + a, t))
            if not forced:
                for new, extra, letter in ((role, 0, "K"), ("user", 1, "R"), ("assistant", 1, "R")):
                    if new[:1] and new[0] in follows:
                        c, a, t = best(at + 1, new[0], 0)
                        out.append((c + extra + 5 * truncated, letter + a, ((new, text), *t)))
        return min(out, default=(10**9, "", ()))

    return best(0, "", 0)


def brute_report(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, out, blank, duplicate, truncated = set(), [], 0, 0, 0
    for _, _, role, text in rows:
        words = re.sub(r"[\x20\x09-\x0D]+", "", text)
        one = not words
        two = not one and (role, text) in seen
        three = not one and not two and words[-1] not in ".!?"
        seen.add((role, text))
        blank, duplicate, truncated = blank + one, duplicate + two, truncated + three
        out.append((role, text, one or two, three))
    turns = [r[1] for r in rows if r[1] is not None]
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, turns_made = brute_repair(tuple(out))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns_made).encode()).hexdigest()
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, blank, duplicate, truncated, illegal, cost, audit, sha)


def conversations():
    rng = random.Random(5)
    texts = ["Yes.", "No", "What?", "", " \n", "Fine! ", "end. ", "trail  ", "é.", None, "long " * 30 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "Assistant", "admin"]
    out = []
    for conv in [None, *range(1, 60)]:
        out += [(conv, rng.choice([None, *range(9)]) if rng.random() < 0.3 else k, rng.choice(roles[: rng.choice([2, 4, 10])]), rng.choice(texts)) for k in range(rng.randint(1, 9))]
    out += [(60, k, "system" if not k else ("assistant", "user")[k % 2], f"Turn {k}.") for k in range(9)]
    out += [(61, 3, "user", "Same.")] * 4 + [(62, 10**12, "user", "Far."), (62, 1, "user", "Near.")]
    return out


CONV = "conv_id long, turn long, role string, text string, conv string, no long, n int, block long, edits string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, "y") for r in rows], CONV).repartition(3)


@pytest.mark.parametrize("bits", [16, 1])
def test_op11_against_all_edits(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(C, "BLOCK_BITS", bits)  # 1: blocks of two rows, so nearly all conversations are chained
    given = conversations()
    frame(spark, given).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r)[1:] for r in registry.queries()["op11_conversation_repair"](spark, str(tmp_path)).collect()}
    damaged = brute_damage(given)
    assert set(got) == {r[0] for r in given} and len(got) == 63
    for conv, row in got.items():
        assert row == brute_report([r for r in damaged if r[0] == conv]), conv


def test_op11_chain_and_trace_agree_for_any_cut():
    rng = random.Random(8)
    for _ in range(300):
        codes = [rng.randrange(9) for _ in range(rng.randint(1, 9))]
        rows = tuple(({"s": "system", "u": "user", "a": "assistant", "?": "tool"}[C.INITIALS[c & 3]], "x", c == C.FORCED, bool(c & 4)) for c in codes)
        cost, audit, _ = brute_repair(rows)
        for size in (1, 2, 3, 9):
            parts = [codes[k : k + size] for k in range(0, len(codes), size)]
            total, ahead, behind = C.chain([C.transfer(p) for p in parts])
            assert total == cost
            state, letters = C.START, ""
            for k, p in enumerate(parts):
                state, own = next((z, rows) for a, z, rows in C.trace(p, ahead[k], behind[k + 1], total, k == len(parts) - 1) if a == state)
                letters += "".join(own)
            assert letters == audit


def test_op11_turns_are_legal(spark):
    rows = spark.createDataFrame([(f"c{r[0]}", r[1], key(r[2]), key(r[3]), 1) for r in conversations()], "conv string, turn long, role string, text string, n long").groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n"))
    turns = {}
    for r in C.Repair(rows).turns().collect():
        turns.setdefault(r["conv"], []).append((r["place"], r["role"][:1]))
    assert turns and all(re.fullmatch("s?(ua)+", "".join(i for _, i in sorted(t))) for t in turns.values())


def test_op11_empty(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/conversations.parquet")
    assert registry.queries()["op11_conversation_repair"](spark, str(tmp_path)).collect() == []


# ---- token files

PUBLIC = pytest.importorskip("public_tokenizers")


def documents():
    rng = random.Random(3)
    words = ["alpha", "Beta", "don't", "ΟΔΟΣ", "İstanbul", "été", "́x", "12345", "漢字", "🙂🙂", "<|endoftext|>", "a<|startoftext|>b", "x y", " ", "l\x1cm", "\x85", "ǅ", "'s", "...", "\x0b\x0c", "ﬁ", "x" * 300]
    out = [(k, rng.choice([" ", "  ", "\n", "\t ", "\x0b"]).join(rng.choices(words, k=rng.randint(0, 40)))) for k in range(120)]
    out += [(None, "no id"), (None, None), (7, "again"), (7, "again"), (500, None), (501, ""), (502, " \n "), (503, "́ ́a"), (504, "y" * 20_000), (2**40, "far")]
    return out


def test_op12_against_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PUBLIC.path("word_bpe_49k.json"))
    spark.createDataFrame([(k, t, 5, "z", None) for k, t in documents()], "doc_id long, text string, at long, ids string, n_tokens long").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["op12_orc_tokens"](spark, str(tmp_path)).collect()
    want = {}
    for k, t in documents():
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        want.setdefault(k, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    have = {}
    for r in got:
        have.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    in_order = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in in_order] == [0, *itertools.accumulate(r["n_tokens"] for r in in_order)][:-1]
    ids = [r["doc_id"] for r in in_order]
    assert ids == sorted(ids, key=lambda k: (k is not None, k or 0))


def test_op12_files_have_stripes_indexes_and_bloom_filters(spark, tmp_path):
    orc = pytest.importorskip("pyarrow.orc")
    rows = spark.range(40_000).select((F.col("id") * 2).alias("doc_id"), F.concat_ws(" ", F.sha2(F.col("id").cast("string"), 256), F.sha2((F.col("id") + 1).cast("string"), 256)).alias("text"))
    path = f"{tmp_path}/ids"
    old = O.STRIPE
    O.STRIPE = 1 << 18
    try:
        O.write(rows, path, PUBLIC.path("word_bpe_49k.json"))
    finally:
        O.STRIPE = old
    names = sorted((tmp_path / "ids").glob("*.orc"))
    stripes = [orc.ORCFile(str(f)).nstripes for f in names]
    assert sum(stripes) > len(names)  # files of several stripes
    flat = [k for f in names for k in orc.ORCFile(str(f)).read(columns=["doc_id"])["doc_id"].to_pylist()]
    assert flat == list(range(0, 80_000, 2))  # another reader finds ids in ascending order over the files
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 18))
    try:
        assert O.read(spark, path).rdd.getNumPartitions() > len(names)  # tasks share a file by its stripes
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [tuple(r)[::2] for r in O.lookup(spark, path, [60_002]).select("doc_id", "start", "n_tokens").collect()] == [(60_002, O.read(spark, path).where("doc_id = 60002").first()["n_tokens"])]

    def scanned(ids):
        df = spark.read.orc(path).where(F.col("doc_id").isin(ids)).select("doc_id", "n_tokens")
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        leaves = plan.collectLeaves()
        return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))

    assert 0 < scanned([60_002]) <= 2 * O.STRIDE  # statistics leave a stride or so
    # odd numbers lie within the range of some stride: only Bloom filters can rule them out
    assert sum(scanned([k]) for k in range(1001, 60_001, 5900)) <= 2 * O.STRIDE


def test_op12_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert registry.queries()["op12_orc_tokens"](spark, str(tmp_path)).collect() == []


def test_op12_forgets_chunks(spark):
    import pyarrow as pa

    full, small = (O.Encoder(PUBLIC.path("word_bpe_49k.json"), n) for n in (1000, 1))
    texts = pa.array([t for _, t in documents()])
    for _ in range(2):
        assert full.encode(texts).equals(small.encode(texts))
    assert full.encode(texts.slice(5, 20)).to_pylist() == full.encode(texts).to_pylist()[5:25] and len(small.young) <= 1


# ---- filter audit


def audited():
    rng = random.Random(9)
    out = []
    for k in range(150):
        n = rng.choice([0, 5, 49, 50, 60, 120])
        words = [rng.choice("abcdefghij") * rng.randint(1, 12) for _ in range(n)]
        if rng.random() < 0.3:
            words = [w.upper() if rng.random() < 0.3 else w for w in words]
        out.append((k, rng.choice([" ", "\n", " \t"]).join(words) + rng.choice(["", "", "#", " &", " "]), rng.choice(["a", "b", "", None])))
    out += [(200 + k, out[k][1], "a") for k in range(0, 150, 3)]
    return [*out, (None, out[0][1], "c"), (None, None, "c"), (300, None, "a"), (301, "", "b"), (5, out[5][1], "a"), (5, out[5][1], "a"), (5, "other", "d"), (-1, "é" * 30 + "A B", "d")]


def brute_audit(rows, quality, toxic):
    least = {}
    for k, t, _ in rows:
        if k is not None:
            least[t or ""] = min(least.get(t or "", k), k)
    fails = []
    for k, t, s in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        flags = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), k is not None and k > least[t])
        fails.append((s or "", {c for c, f in zip("ABCDE", flags, strict=True) if f}, k in quality, k in toxic))
    out = set()
    for part in {f[0] for f in fails}:
        own = [f for f in fails if f[0] == part]
        cells, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, c in enumerate(order):
                gone = [f for f in left if c in f[1]]
                left = [f for f in left if c not in f[1]]
                shapley[c] += len(gone)
                cells.append(("".join(order), k + 1, c, len(left), len(gone), sum(c in f[1] for f in own) - len(gone), sum(f[1] == {c} for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone)))
        out |= {(part, o, k, *n, shapley[c]) for o, k, c, *n in cells}
    return out


def test_op13_against_all_orders(spark, tmp_path):
    spark.createDataFrame([(*r, "x", 1, True) for r in audited()], "doc_id long, text string, source string, part string, n long, few boolean").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, int(k % 2 == 0), int(k % 5 == 0)) for k in range(0, 310, 2)] + [(None, 1, 1), (7, None, None), (4, 0, 0)]
    spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, id string").write.parquet(f"{tmp_path}/labels.parquet")
    got = registry.queries()["op13_filter_audit"](spark, str(tmp_path)).collect()
    names = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    want = brute_audit(audited(), {k for k, q, _ in labels if q == 1 and k is not None}, {k for k, _, t in labels if t == 1 and k is not None})
    assert len(got) == len(want) == 600 * 5
    assert {tuple(r[c] for c in names) for r in got} == want


def test_op13_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert registry.queries()["op13_filter_audit"](spark, str(tmp_path)).collect() == []


def test_op13_words_by_document(spark):
    got = A.word_flags(spark.createDataFrame([(1, "a b a"), (1, "a b a"), (2, ""), (3, None), (4, " c\n")], "doc_id long, text string")).collect()
    assert {(r["id"], r["copies"], r["n_words"], r["n_distinct"]) for r in got} == {(1, 2, 3, 2), (2, 1, 0, 0), (3, 1, 0, 0), (4, 1, 1, 1)}


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op13_filter_audit"])
def test_equals_sql(spark, name):
    import os

    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, sf).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
