"""The corpus pipeline, stage by stage, against plain Python."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from sparkfolio.llm import mixing, packing, quality
from sparkfolio.llm.common import staged
from tests.llm.test_operators import brute_components, check_sequences, word_set

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus():
    rnd = random.Random(12)
    words = [f"Word{i}" for i in range(300)]
    sentence = lambda: " ".join(rnd.choices(words, k=12)) + "."
    shared = [sentence() for _ in range(3)]
    rows = []
    for i in range(160):
        lines = [sentence() for _ in range(rnd.randrange(4, 9))]
        if i % 5 == 0:
            lines.insert(2, rnd.choice(shared))
        if i % 7 == 0:
            lines.append("home | about | news | more | login")
        if i % 11 == 0:
            lines = ["### $$$ %%% &&& stuff."] * 40
        if i % 13 == 0:
            lines = lines[:1]
        text = "\n".join(lines)
        if rows and i % 6 == 0 and len(rows[-1][1]) > 400:  # a near copy in other lines
            flat = rows[-1][1].split()
            flat[5] = "other"
            text = "\n".join(" ".join(flat[k : k + 17]) for k in range(0, len(flat), 17))
        rows.append((i, text, ["en", "de", None][i % 3], f"src{i % 6}", len(text)))
    return [*rows, (900, "", "en", "src1", 0), (901, None, "en", "src1", 0)]


def line_fails(line):
    symbols = len(re.findall(quality.SYMBOLS, line))
    return (
        symbols > len(line) * quality.MAX_SYMBOL_SHARE
        or line.count("|") >= quality.NAV_SEPARATORS
        or (len(line) <= quality.MENU_MAX_CHARS and re.search(quality.MENU, line))
        or (len(line) <= quality.BOILERPLATE_MAX_CHARS and re.search(quality.BOILERPLATE, line))
        or (not re.search("[.,;:!?]", line) and len(line.split()) >= quality.UNPUNCTUATED_WORDS)
    )


def by_quality(docs):
    for i, text, lang, source, _ in docs:
        text = text or ""
        words = text.split()
        windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {k + j for k, x in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[x] > 1 for j in range(3)}
        good = "\n".join(x for x in text.split("\n") if not line_fails(x))
        if len(words) >= 50 and 100 * len(covered) <= 50 * len(words) and len(text) - len(good) <= 0.5 * len(text):
            yield i, good, lang, source, len(good)


def by_lines(docs):
    docs, first = list(docs), {}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LETTERS)
    holders = collections.defaultdict(set)
    for i, text, *_ in docs:
        for line in text.split("\n"):
            holders[key(line)].add(i)
    first = {k: min(v) for k, v in holders.items() if len(v) > 1 and len(k) >= 10}
    for i, text, lang, source, _ in docs:
        kept = "\n".join(x for x in text.split("\n") if first.get(key(x), i) == i)
        yield i, kept, lang, source, len(kept)


def by_near_copies(docs):
    docs = list(docs)
    component = brute_components({d[0]: word_set(d[1], 5) for d in docs}, 80)
    return [d for d in docs if component[d[0]] == d[0]]


def filled(budget, nodes):
    """Water level by bisection over exact steps: nodes are (cap, weight)."""
    open_nodes, level, left = dict(enumerate(nodes)), 0.0, budget
    given = [0] * len(nodes)
    while open_nodes:
        level = left / sum(w for _, w in open_nodes.values())
        full = {k: c for k, (c, w) in open_nodes.items() if c <= level * w}
        if not full:
            break
        for k, c in full.items():
            given[k] = c
            left -= c
            del open_nodes[k]
    for k, (_, w) in open_nodes.items():
        given[k] = int(level * w)
    return given


def by_mix(docs):
    docs = list(docs)
    domain = lambda s: mixing.DOMAINS[int(re.search("[0-9]+$", s)[0]) % 4]
    tokens = collections.Counter()
    for i, text, lang, source, _ in docs:
        tokens[domain(source), lang or "", source] += len(text.split())

    def level(budget, names, weights, cap):
        return dict(zip(names, filled(budget, [(cap(n), weights.get(n, mixing.DEFAULT_WEIGHT)) for n in names]), strict=True))

    total = int(sum(tokens.values()) * corpus_pipeline.MIX["budget_percent"] / 100)
    domains = sorted({k[0] for k in tokens})
    budgets, chosen = {}, set()
    for d, x in level(total, domains, mixing.DOMAIN_WEIGHTS, lambda n: sum(t for k, t in tokens.items() if k[0] == n)).items():
        langs = sorted({k[1] for k in tokens if k[0] == d})
        for g, y in level(x, langs, mixing.LANG_WEIGHTS, lambda n: sum(t for k, t in tokens.items() if k[:2] == (d, n))).items():
            sources = sorted({k[2] for k in tokens if k[:2] == (d, g)})
            for s, z in level(y, sources, {}, lambda n: tokens[d, g, n]).items():
                budgets[d, g, s] = z
    for leaf, budget in budgets.items():
        if tokens[leaf]:
            epochs, rest = divmod(budget, tokens[leaf])
            mine = [d for d in docs if (domain(d[3]), d[2] or "", d[3]) == leaf]
            mine.sort(key=lambda d: hashlib.md5(f"{mixing.SEED}:{epochs}:{d[0]}".encode()).hexdigest())
            at = 0
            for d in mine:
                at += len(d[1].split())
                if epochs or at <= rest:
                    chosen.add(d)
    return chosen


def test_every_stage_against_plain_python(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    sizes = [len(docs)]
    for (_, stage), plain in zip(corpus_pipeline.STAGES[:-1], (by_quality, by_lines, by_near_copies, by_mix), strict=True):
        df, docs = staged(stage(spark, df, None)), list(plain(docs))
        assert df.columns == corpus_pipeline.COLUMNS
        assert {tuple(r) for r in df.collect()} == set(docs)
        sizes.append(len(docs))
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] > sizes[4] > 50
    rows = corpus_pipeline.STAGES[-1][1](spark, df, None).collect()
    tokenizer = Tokenizer.from_file(public.path(packing.TOKENIZER))
    want = {(d[0], zlib.crc32(np.array([*tokenizer.encode(d[1], add_special_tokens=False).ids, 1], dtype="<u4").tobytes())) for d in docs}
    assert {(r.doc_id, r.ids_crc32) for r in rows} == want
    check_sequences(rows)


def test_stages_take_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df, None).count() == 0


def prose(seed, n=9):
    rnd = random.Random(seed)
    return "\n".join(" ".join(f"w{rnd.randrange(10**6)}" for _ in range(10)) + "." for _ in range(n))


def odd_rows():
    a, near = prose(1), prose(1).replace("\n", " \n", 1)
    near = " ".join([*near.split()[:-1], "changed."])
    return [
        (1, a, "en", "src1", 1), (1, a, "en", "src1", 1), (2, near, "en", "src1", 1), (None, a, "en", "src1", 1), (None, prose(2), None, None, None),
        (3, None, "en", "src1", 1), (4, "", "en", "src1", 1), (5, prose(5), None, None, 1), (6, prose(6), "en", "src2", 1), (7, prose(7), "en", "src2", 1),
    ]


def test_stages_take_null_ids_repeated_rows_null_texts_and_ties(spark):
    """Each stage on rows that no stage before it would have passed on."""
    rows = odd_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    stage = dict(corpus_pipeline.STAGES)
    run = lambda name: [tuple(r) for r in stage[name](spark, df, None).collect()]
    count = lambda got: collections.Counter(r[0] for r in got)

    got = run("quality_rules")
    assert count(got) == {1: 2, 2: 1, None: 2, 5: 1, 6: 1, 7: 1}
    assert {r[1] for r in got if r[0] == 1} == {rows[0][1]}

    got = run("line_dedup")
    text = collections.defaultdict(set)
    for r in got:
        text[r[0]].add(r[1])
    assert len(got) == len(rows) and text[1] == {rows[0][1]} and text[None] == {rows[3][1], rows[4][1]} and text[3] == text[4] == {""}

    got = run("minhash_near_dedup")
    assert count(got) == {1: 1, None: 2, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1}

    got = count(run("source_mixing"))
    assert got[1] in (0, 2) and set(got) <= {r[0] for r in rows} and sum(got.values()) >= 4

    pieces = stage["best_fit_packing"](spark, df, None).collect()
    assert count([(p.doc_id,) for p in pieces]) == {1: 2, 2: 1, None: 2, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1}
    assert sorted(p.length for p in pieces if p.doc_id in (3, 4)) == [1, 1]
    check_sequences(pieces)


def test_stages_give_the_same_rows_in_any_order(spark):
    """Ties are broken by what rows hold, not by where they lie."""
    rows = odd_rows()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        one, two = (sorted(map(repr, map(tuple, stage(spark, spark.createDataFrame(r, schema).repartition(n), None).collect()))) for r, n in ((rows, 1), (rows[::-1], 4)))
        assert one == two, name
