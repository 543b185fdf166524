"""Periodic runs, repaired conversations and token files against brute force and round trips."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfolio.llm import chat, lattice, queries, repair, runs, token_files

ODD_SCHEMA = "doc_id long, text string, n_words string, runs int, start string"


# -- runs ---------------------------------------------------------------------------------------------------------


def slow_runs(w):
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i:
                n = j - i + q
                x = w[i : i + n]
                if n >= max(6, 4 * q) and not any(x[r:] == x[: n - r] for r in range(1, q)):
                    found.append((i, n, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def slow_collapse(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def planted(rng):
    n, k = rng.choice([0, 1, 5, 6, 7, 25, 70, 160]), rng.choice([1, 2, 3, 40])
    w = [str(rng.randrange(k)) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n > 8:
            a, p = rng.randrange(n), 1 + rng.randrange(n // 3)
            for i in range(a, rng.randrange(a, n) + 1):
                w[i] = w[a + (i - a) % p]
    return w


def test_runs_of_random_words_together_against_brute_force():
    rng = random.Random(4)
    total = 0
    for _ in range(150):
        texts = [planted(rng) for _ in range(rng.randint(1, 8))]
        for w, found in zip(texts, runs.runs_of(texts), strict=True):
            assert found == slow_runs(w), w
            assert runs.collapse(w, found) == slow_collapse(w, found)
            total += len(found)
    assert total > 100


def test_range_successor_against_brute_force():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 17, 64, 100):
        v = rng.permutation(n)
        tree = runs.WaveletMatrix(v)
        lo = rng.integers(0, n, 200)
        hi = np.minimum(n, lo + rng.integers(1, n + 1, 200))
        bound = rng.integers(0, n, 200)
        below = tree.below(lo, hi, bound)
        assert below.tolist() == [int((v[a:b] < x).sum()) for a, b, x in zip(lo, hi, bound, strict=True)]
        k = rng.integers(0, hi - lo)
        assert tree.smallest(lo, hi, k).tolist() == [int(np.sort(v[a:b])[i]) for a, b, i in zip(lo, hi, k, strict=True)]


def test_runs_of_odd_and_long_texts(spark):
    words = [f"w{i}" for i in range(20_000)]
    long = " ".join(words[:3000] + [words[i % 5000] for i in range(3000, 27_000)])
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, "a a a a a"), (5, "a a a a a a"), (5, "a a a a a a"), (None, "x y " * 10), (6, long), (7, "é\x1cb " * 6), (8, "a\x0bb\x0ca\rb a b a b")]
    df = spark.createDataFrame([(d, t, "clash", 1, "clash") for d, t in texts], ODD_SCHEMA)
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.periodic_runs(df, together=50).collect()]
    want = []
    for d, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        found = slow_runs(w) if len(w) < 1000 else [(0, 27_000, 5000)]
        want.append((d, len(w), found, " ".join(slow_collapse(w, found))))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert runs.periodic_runs(df.limit(0)).collect() == []


def test_runs_query_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    docs = [(i, " ".join(planted(rng))) for i in range(150)] + [(200, None), (201, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(docs)
    for d, t in docs:
        w = (t or "").split()
        n, h = len(w), zlib.crc32(str(d).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = slow_runs(w)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        assert got[d] == (len(found), *figures, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(" ".join(slow_collapse(w, found)).encode()).hexdigest())


# -- conversations ------------------------------------------------------------------------------------------------


def slow_repair(kinds):
    """Cost and letters by trying everything: up to two insertions before each turn and at the end."""
    best = (2 * len(kinds), "D" * len(kinds))

    def go(i, roles, cost, audit, put):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(kinds) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best, (cost, audit))
        if put < 2:
            for r in "ua":
                go(i, roles + r, cost + 5, audit + "I", put + 1)
        if i < len(kinds):
            go(i + 1, roles, cost + 2, audit + "D", 0)
            if kinds[i] != "d":
                more = 5 if kinds[i].isupper() else 0
                go(i + 1, roles + kinds[i].lower(), cost + more, audit + "K", 0)
                for r in "ua":
                    go(i + 1, roles + r, cost + 1 + more, audit + "R", 0)

    go(0, "", 0, "", 0)
    return best


def joined(kinds, size):
    cost, parts = repair.combine([repair.transfers(kinds[i : i + size]) for i in range(0, len(kinds), size)])
    return cost, "".join(x for _, x in parts)


def test_least_weights_against_everything_tried():
    rng = random.Random(6)
    for _ in range(250):
        kinds = "".join(rng.choice("suaxSUAXduaua") for _ in range(rng.randint(0, 5)))
        want = slow_repair(kinds)
        for size in (1, 2, 9):
            assert joined(kinds, size) == want, (kinds, size)


def test_chunks_together_are_the_whole():
    rng = random.Random(7)
    for _ in range(30):
        kinds = "".join(rng.choice("suaxSUAXduaua") for _ in range(rng.randint(40, 200)))
        assert joined(kinds, 1000) == joined(kinds, 7) == joined(kinds, 64)


def slow_summary(rows):
    """What the operator says of one conversation (turn, role, text), from whole lists."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    kinds, faults, seen = "", [], set()
    for _, r, x in rows:
        kind, fault = repair.kind_of(r, x, (r, x) in seen)
        seen.add((r, x))
        kinds += kind
        faults.append(fault)
    cost, audit = joined(kinds, len(kinds))
    out, at = [], 0
    for c in audit:
        if c == "K":
            out.append((rows[at][1], rows[at][2]))
        elif c in "RI":
            # the next role of s?(ua)+
            users = len(out) - (1 if out and out[0][0][0] == "s" else 0)
            out.append(("user" if users % 2 == 0 else "assistant", rows[at][2] if c == "R" else ""))
        at += c != "I"
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    bad = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), bad, cost, audit, digest)


@pytest.mark.parametrize("size", [2, 5, 256])
def test_conversations_in_chunks_against_plain_python(spark, size):
    rng = random.Random(size)
    says = ["One.", "Two!", "three", "", " \n", None, "One.", "Long " * 50, "Ende?"]
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), rng.choice(says)) for c in [*range(40), None] for _ in range(rng.randint(1, 12))]
    rows += [(99, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(61)]  # longer than a range, all well but for its end
    rows += [(98, 1, "user", "same.")] * 30
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, chunk string, cost int").repartition(5)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.summary(df, size=size).collect()}
    assert set(got) == {r[0] for r in rows}
    for c in got:
        assert got[c] == slow_summary([r[1:] for r in rows if r[0] == c]), c
    turns = repair.repair(df, size=size).select("conv_id", "chunk", F.explode("turns").alias("t")).select("conv_id", "t.*").where("conv_id = 99").collect()
    assert len(turns) == 60 or len(turns) == 62
    assert repair.summary(df.limit(0)).collect() == [] == repair.repair(df.limit(0)).collect()


def test_conversations_of_which_nothing_is_left(spark, tmp_path):
    damage = lambda c, t: zlib.crc32(f"{c}:{t}".encode()) % 20
    gone = next(c for c in range(1000) if damage(c, 0) == 0)
    spark.createDataFrame([(gone, 0, "user", "Hi."), (5, None, None, None), (None, 1, "user", "a.")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, str(tmp_path)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", empty)
    assert set(got) == {gone, 5, None}


# -- token files --------------------------------------------------------------------------------------------------


def test_blocks_come_back():
    rng = np.random.default_rng(5)
    for t in range(200):
        n = int(rng.integers(0, 2000))
        ids = rng.integers(0, [1, 2, 300, 49408, 2**32, 2**20][t % 6], n, dtype=np.uint64)
        if n and t % 3 == 0:
            ids[rng.integers(0, n, n // 9 + 1)] = rng.integers(0, 2**32, n // 9 + 1, dtype=np.uint64)
        if n and t % 4 == 0:
            ids[: n // 2] = 0
        words, at, escaped = token_files.encode(ids.astype("<u4"))
        assert (token_files.decode(words, at, escaped, n) == ids).all()
    ids = np.full(600, 7, dtype="<u4")
    ids[100] = 2**32 - 1  # one id does not widen the others: it is an escape
    words, at, escaped = token_files.encode(ids)
    assert at.tolist() == [100] and escaped.tolist() == [2**32 - 1] and len(words) <= 600 / 20 + 2
    assert len(token_files.encode(np.zeros(480, dtype="<u4"))[0]) == 2


def tokens(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [[*e.ids, 1] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize(("block", "most"), [(65_536, 1 << 25), (64, 5)])
def test_files_against_the_tokenizer(spark, tmp_path, block, most):
    texts = [(3, "Hello, World!"), (1, None), (2, ""), (7, "naïve café 漢字 <|endoftext|>"), (None, "no id"), (9, "word " * 3000), (4, "same"), (4, "same"), (4, "other"), (-5, "first")]
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in texts], "doc_id long, text string, start string, ids int").repartition(4)
    path = f"file://{tmp_path}/ids"
    token_files.write_ids(df, path, block=block, file_ids=most)
    rows = sorted(token_files.read_ids(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, -5, 1, 2, 3, 4, 4, 4, 7, 9]
    at = 0
    for r in rows:
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
        at += r["n_tokens"]
    want = sorted((repr(d), ids) for (d, _), ids in zip(texts, tokens([t for _, t in texts]), strict=True))
    assert sorted((repr(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist()) for r in rows) == want
    if most == 5:
        assert spark.read.parquet(f"{path}/_manifest").count() > 1


def test_no_documents_and_files_that_do_not_count(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    token_files.write_ids(df, str(tmp_path / "none"))
    assert token_files.read_ids(spark, str(tmp_path / "none")).collect() == []
    token_files.write_ids(spark.createDataFrame([(1, "a b c")], df.schema), str(tmp_path / "one"))
    stray = token_files.Writer(str(tmp_path / "one"))  # of an attempt that was lost
    stray.add(2, b"\x05\x00\x00\x00")
    stray.close()
    assert [r["doc_id"] for r in token_files.read_ids(spark, str(tmp_path / "one")).collect()] == [1]
    (tmp_path / "bad").write_bytes(b"x" * 80)
    with pytest.raises(ValueError, match="not a file of token ids"):
        list(token_files.read_file(str(tmp_path / "bad")))


# -- lattice ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("dim", [4, 8, 16, 64, 256, 768, 1536])
def test_recall_and_random_candidates_at_each_dimension(dim):
    """Pairs just above the threshold meet, and random ones do not, whatever the dimension."""
    rng, n, cosine = np.random.default_rng(dim), 1500, 0.9801
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a, z = unit(rng.standard_normal((n, dim))), rng.standard_normal((n, dim))
    b = cosine * a + np.sqrt(1 - cosine**2) * unit(z - (z * a).sum(axis=1, keepdims=True) * a)
    tables, label = lattice.Tables(dim, lattice.TABLES, lattice.PROBES, lattice.SCALE * 0.2, lattice.SEED), np.ones(n, dtype=np.int64)
    ca, cb = tables.cells(a, label), tables.cells(b, label)

    def met(x, y):
        return np.any([(x[t, 0] == y[t, 0]) | (x[t, 0] == y[t, 1:]).any(0) | (y[t, 0] == x[t, 1:]).any(0) for t in range(lattice.TABLES)], axis=0).mean()

    assert met(ca, cb) >= 0.99
    assert np.mean([met(ca, np.roll(ca, k, axis=2)) for k in range(1, 8)]) <= (0.05 if dim < 8 else 0.01)


@pytest.mark.parametrize(("dim", "kind"), [(6, "double"), (900, "float")])
def test_links_of_long_and_short_vectors_against_all_pairs(spark, dim, kind):
    rng = np.random.default_rng(dim)
    rows, k = [], 0
    for label in (1, 2, None):
        for _ in range(25):
            centre = rng.standard_normal(dim)
            for _ in range(rng.integers(1, 5)):
                v = centre + rng.standard_normal(dim) * np.linalg.norm(centre) * rng.choice([0.02, 0.12, 0.22]) / np.sqrt(dim)
                rows.append((k, [float(x) for x in v.astype("f4")], label, "clash"))
                k += 1
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, n_links string").repartition(3)
    got = {r["vec_id"]: r["n_links"] for r in lattice.near_duplicate_vectors(df).collect()}
    x = np.array([r[1] for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels = np.array([r[2] or 0 for r in rows])
    close = (x @ x.T >= 0.98) & (labels[:, None] == labels[None, :]) & (labels > 0)[:, None]
    want = close.sum(axis=1) - (labels > 0)
    assert want.sum() > 40
    assert sum(got.values()) >= 0.99 * want.sum() and all(got[i] <= want[i] for i in got)


# -- chat ---------------------------------------------------------------------------------------------------------


def test_turns_with_columns_of_clashing_names_format_as_those_without(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t} #<\\") for c in range(5) for t in range(4)]
    plain = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    names = ["turns", "blocks", "parts", "sized", "starts", "formatted", "loss_spans", "t"]
    clash = plain.select("*", *[F.lit("clash").alias(n) for n in names])
    assert chat.format_conversations(clash).columns == ["conv_id", "formatted", "loss_spans"]
    assert sorted(map(str, chat.format_conversations(clash).collect())) == sorted(map(str, chat.format_conversations(plain).collect()))
