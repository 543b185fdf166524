"""The training-data operators: edge cases for each, and brute-force versions of what SQL can't express."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from sparkfolio.llm import chat, graph, html_text, lattice, licenses, line_dedup, minhash, mixing, packing, quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, kept boolean, n_words string"
LONG = " ".join(f"word{i % 977}" for i in range(30_000)) + "."


def documents(spark, texts, **more):
    return spark.createDataFrame([(i, t, "en", "src1", None, "clash") for i, t in enumerate(texts)], DOCS)


ODD = [None, "", " \t\n", "one", "Same line of text here\nother", "same LINE of text here \nthird", "same LINE of text here \nthird", LONG, "é" * 5000, "\x00\x1c a\x85b"]


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# -- odd rows and empty tables ------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "run",
    [line_dedup.drop_repeated_lines, quality.judge, mixing.mix, packing.pack, minhash.near_duplicates, licenses.scan_licenses],
    ids=lambda f: f.__module__.rsplit(".", 1)[-1],
)
def test_odd_texts_null_ids_repeated_rows_and_empty_tables(spark, run):
    odd = documents(spark, ODD)
    nulls = spark.createDataFrame([(None, "a b c d e f", None, None, None, None), (None, None, None, None, None, None), (3, "one", "en", "src1", None, "clash")], DOCS)
    got = run(odd.unionByName(nulls)).collect()
    if run not in (mixing.mix, packing.pack):
        assert len(got) == len(ODD) + 3
    assert run(odd.limit(0)).collect() == []


def test_conversations_and_vectors_of_odd_rows(spark):
    turns = spark.createDataFrame([(1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (None, 1, "a:b", "x")], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(turns).count() == 2
    assert chat.format_conversations(turns.limit(0)).count() == 0
    v = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], None), (5, [0.0, 0.0], 1), (6, [float("nan"), 1.0], 1), (7, None, 1), (8, [], 1), (9, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (10, [1.0, None], 1)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>, label int")
    got = by_id(lattice.near_duplicate_vectors(df), "vec_id")
    assert {k: (r.n_links, r.component_id) for k, r in got.items() if k in (1, 2, 3)} == {1: (2, 1), 2: (2, 1), 3: (2, 1)}
    assert all(got[k].n_links == 0 and got[k].kept for k in (4, 5, 6, 7, 8, 9, 10, None))
    assert lattice.near_duplicate_vectors(df.limit(0)).count() == 0


# -- 9, 6, 5, 1 ---------------------------------------------------------------------------------------------------


def test_lines_stay_in_the_smallest_document_only(spark):
    got = by_id(line_dedup.drop_repeated_lines(documents(spark, ["x\nA shared line\nA shared line", "a SHARED line \ny", "short\nx"])))
    assert got[0].kept_text == "x\nA shared line\nA shared line" and got[0].n_dropped == 0
    assert got[1].kept_text == "y" and got[1].n_lines == 2 and got[1].n_dropped == 1
    assert got[2].kept_text == "short\nx"


def test_quality_figures_against_plain_python(spark):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["a", "b", "c,", "d#"]) + rnd.choice(["", "\n"]) for _ in range(rnd.randrange(120))) for _ in range(60)]
    got = by_id(quality.judge(documents(spark, texts)))
    for i, t in enumerate(texts):
        words = t.split()
        windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {k + j for k, x in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[x] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if x.split()]
        assert (got[i].n_words, got[i].n_repeat_words, got[i].n_dup_lines, got[i].n_symbols) == (len(words), len(covered), len(lines) - len(set(lines)), t.count("#"))


def test_failing_lines_go_and_documents_that_lose_too_much_are_rejected(spark):
    good = " ".join(f"word{i}" for i in range(60)) + "."
    got = by_id(quality.judge(documents(spark, [good + "\nhome | about | news | more | login", "\n".join(["accept all cookies and go on, reader"] * 2 + [" ".join(f"w{i}" for i in range(60))])])))
    assert got[0].kept and got[0].clean_text == good
    assert not got[1].kept and not got[1].base_failed


def test_formatting_reads_back(spark):
    rnd = random.Random(9)
    data = [(c, t, rnd.choice(["user", "assistant", "a:\\b"]), "".join(rnd.choices("a\\#<>+/ \nturn:", k=rnd.randrange(12)))) for c in range(30) for t in range(rnd.randrange(1, 7))]
    back = by_id(chat.read_back(chat.format_conversations(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))), "conv_id")
    for c in {x[0] for x in data}:
        want = sorted(x[1:] for x in data if x[0] == c)
        assert [(t.role, t.text) for t in back[c].turns] == [(r, t) for _, r, t in want]
        assert back[c].loss_text == "".join(t for _, r, t in want if r == "assistant")


def test_roles_and_texts_of_any_length_read_back(spark):
    turns = [(1, k, r, t) for k, (r, t) in enumerate([("r" * 100_000, "a"), ("assistant", "x" * 200_000 + "\\# <"), ("a:\\:" * 5000, "b"), ("assistant", ""), ("assistant", "c\nd")])]
    turns += [(2, k, ("user", "assistant")[k % 2], f"t{k}") for k in range(3000)]
    out = chat.read_back(chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")))
    for r in out.collect():
        own = [(x[2], x[3]) for x in turns if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == own
        assert r.loss_text == "".join(t for role, t in own if role == "assistant")


CLASH = "doc_id long, text string, lang string, source string, `a.b` long, _words string, _h string, _lines string, _th string, _gone string, _lang string, row string, h string, gone string, `lines` string"


@pytest.mark.parametrize("run", [line_dedup.drop_repeated_lines, quality.judge, mixing.mixed_documents, minhash.deduplicated], ids=lambda f: f.__name__)
def test_columns_of_any_name_come_back_as_they_were(spark, run):
    text = "A line of text that is long enough.\n" * 3 + " ".join(f"word{i} more." for i in range(60))
    rows = [(i, text if i < 2 else f"{text} {i}", "en", "src1", 10 + i, *[f"{c}{i}" for c in "ABCDEFGHIJ"]) for i in range(4)]
    df = spark.createDataFrame(rows, CLASH)
    out = run(df)
    assert out.columns[: len(df.columns)] == df.columns
    got = [tuple(r)[: len(df.columns)] for r in out.collect()]
    assert got and set(got) <= set(rows)


def test_other_columns_long_texts_repeats_and_ties_do_no_harm(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a" + "<b>x</b> " * 50_000, "t", 5), (1, "u", "<p>b", "t", 5), (1, "u", "<p>b", "t", 5), (None, None, None, None, None)], "page_id long, url string, html string, text string, n_chars long")
    got = html_text.extract_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars", "n_lines"] and sorted(r.n_chars or 0 for r in got.collect()) == [0, 1, 1, 100_000]
    vectors = spark.createDataFrame([(3, [1.0, 0.0], 1, "x", "y"), (3, [1.0, 0.0], 1, "x", "y"), (2, [1.0, 0.001], 1, "x", "y"), (9, [0.0, 1.0], 1, "x", "y")], "vec_id long, embedding array<double>, label int, node string, cell string")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in lattice.near_duplicate_vectors(vectors).collect())
    assert got == [(2, 2, 2), (3, 2, 2), (3, 2, 2), (9, 0, 9)]
    # two rows of one doc_id with other texts have the same key of order: both are units of their own
    docs = spark.createDataFrame([(1, "a b", "en", "src1"), (1, "c d", "en", "src1"), (1, "c d", "en", "src1")], "doc_id long, text string, lang string, source string")
    chosen = mixing.mix(docs, budget_percent=100, max_epochs=1).collect()
    assert sorted(r.n_tokens for r in chosen) == [2, 4]
    labelled = spark.createDataFrame([(i, f"you are a worthless loser {i}" if i % 2 else f"the weather is calm today {i}", i % 2) for i in range(200)], "doc_id long, text string, toxic int")
    model = toxicity.fit(labelled, labelled)
    more = spark.createDataFrame([(1, "word " * 200_000 + "worthless", "x"), (2, "calm", "x"), (2, "calm", "x"), (None, None, "x")], "doc_id long, text string, score string")
    rows = toxicity.score(more, model).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows if r.doc_id == 2}) == 1


def test_a_line_that_most_documents_hold_goes_from_all_but_one(spark, monkeypatch):
    texts = [f"own line number {i}\nThe very same footer line\nshared by {i // 2:06d} two" for i in range(200)]
    want = [(i, 3, (i > 0) + i % 2) for i in range(200)]
    for share in (1000, 10, 1):  # all keys hot, some, none
        monkeypatch.setattr(line_dedup, "HOT_SHARE", share)
        got = line_dedup.drop_repeated_lines(documents(spark, texts)).collect()
        assert sorted((r.doc_id, r.n_lines, r.n_dropped) for r in got) == want


def test_shortages_go_to_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame([("web", "en", "a", 100), ("web", "en", "b", 5), ("web", "de", "c", 100), ("books", "en", "d", 1000)], "domain string, lang string, source string, tokens long")
    got = {r.source: r.leaf_budget for r in mixing.leaf_budgets(leaves, budget_tokens=200, max_epochs=1, domain_weights={"web": 1, "books": 1}, lang_weights={"en": 1, "de": 1}).collect()}
    assert got == {"a": 45, "b": 5, "c": 50, "d": 100}


def test_prefixes_hold_the_budget_and_epochs_repeat(spark):
    docs = spark.createDataFrame([(i, "a b c d", "en", "src0") for i in range(100)], "doc_id long, text string, lang string, source string")
    got = mixing.mix(docs, budget_tokens=600, max_epochs=3).collect()
    assert len(got) == 150 and collections.Counter(r.epoch for r in got) == {0: 100, 1: 50}


# -- 2, 10 and components -----------------------------------------------------------------------------------------


def brute_components(sets, percent):
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i in ids}


def word_set(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def test_near_duplicates_against_all_pairs(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [[rnd.choice(words) for _ in range(rnd.randrange(5, 160))] for _ in range(12)]
    texts = []
    for b in base:  # chains of copies that drift apart, so that stars alone would miss links
        for _ in range(16):
            b = [rnd.choice(words) if rnd.random() < 0.02 else w for w in b]
            texts.append(" ".join(b))
    texts += ["", None, "x", "x", "X", "a b", *texts[:5]]
    got = by_id(minhash.near_duplicates(documents(spark, texts), shingle_words=3, percent=85))
    want = brute_components({i: word_set(t, 3) for i, t in enumerate(texts)}, 85)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(word_set(texts[i], 3)) and r.kept == (want[i] == i) for i, r in got.items())


def test_blocks_of_one_bucket_find_every_link_between_components(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_HASHES", 300)
    test_near_duplicates_against_all_pairs(spark)


def test_rows_of_one_doc_id_follow_their_own_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    df = spark.createDataFrame([(1, a, "x"), (5, a, "x"), (5, b, "x"), (5, b, "x"), (9, b + " end", "x"), (9, b, "x"), (None, a, "x"), (7, "", "x"), (7, None, "x")], "doc_id long, text string, th string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in minhash.near_duplicates(df, shingle_words=3, percent=85).collect())
    assert got == [(0, 58, 0), (1, 58, 1), (5, 58, 1), (5, 58, 5), (5, 58, 5), (7, 0, 7), (7, 0, 7), (9, 58, 5), (9, 59, 5)]
    kept = minhash.deduplicated(df, shingle_words=3, percent=85)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(0, a), (1, a), (5, b), (7, ""), (7, "")])


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100)] + [(500, 500 + i) for i in range(50)] + [(7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(101), 0), **dict.fromkeys(range(500, 550), 500)}


def test_lattice_points_are_nearest_and_links_reach_recall(spark):
    rnd = np.random.default_rng(2)
    y = rnd.normal(size=(200, 8))
    at = lattice.nearest_e8(y)
    assert (((y - at) ** 2).sum(1)[:, None] <= ((y[:, None] - at[:, None] - lattice.SHORTEST) ** 2).sum(2) + 1e-9).all()
    centres = rnd.normal(size=(40, 64))
    x = np.repeat(centres, 12, axis=0)
    x = x / np.linalg.norm(x, axis=1, keepdims=True) + rnd.normal(size=(480, 64)) * 0.0165
    df = spark.createDataFrame([(i, [float(np.float32(v)) for v in r], int(i % 2)) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = by_id(lattice.near_duplicate_vectors(df), "vec_id")
    u = np.float32(x).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (np.arange(480)[:, None] % 2 == np.arange(480)[None, :] % 2) & ~np.eye(480, dtype=bool)
    found = sum(r.n_links for r in got.values())
    assert near.sum() > 500 and 0.98 * near.sum() <= found <= near.sum()
    assert all(got[i].n_links <= near[i].sum() for i in range(480))


# -- 3 ------------------------------------------------------------------------------------------------------------


def test_packing_against_the_tokenizer(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    rnd = random.Random(6)
    texts = ["".join(rnd.choices("aAbé.,!?'’ \t\n\x0b\x1c09İΣ#<|>", k=rnd.randrange(60))) for _ in range(200)] + [None, "", LONG, "<|endoftext|> x", "word, word. Word!"]
    tokenizer = Tokenizer.from_file(public.path(packing.TOKENIZER))
    want = set()
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want |= {(i, k, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], dtype="<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))}
    got = packing.pack(documents(spark, texts)).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want
    check_sequences(got)
    assert packing.pack(documents(spark, texts[:3]), keep_ids=True).first().ids is not None


def check_sequences(rows):
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= -(-sum(r.length for r in rows) // 4096) + 1


def test_plan_uses_each_length_up_and_stays_near_the_bound():
    rnd = random.Random(7)
    for n in (1, 50, 3000):
        counts = collections.Counter(min(4096, int(rnd.lognormvariate(6, 1)) + 1) for _ in range(n))
        runs = packing.plan(dict(counts))
        used = collections.Counter()
        for times, pattern in runs:
            assert sum(length * k for length, k in pattern) <= 4096
            for length, k in pattern:
                used[length] += times * k
        assert used == counts
        assert sum(t for t, _ in runs) <= -(-sum(k * c for k, c in counts.items()) // 4096) * 1.02 + 1


# -- 4, 7, 8 ------------------------------------------------------------------------------------------------------


def test_phrases_and_templates(spark):
    texts = ["The MIT-License, the mit license", "Apache License, Version 2.0", "cc-by-nc cc by", "Licensed under the GNU General Public License, version 3", "of the and to this software", "the mit " * 5]
    got = by_id(licenses.scan_licenses(documents(spark, texts)))
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (2, 0, 3, "mit")
    assert (got[1].n_base, got[1].base_labels) == (1, "apache-2")
    assert (got[2].n_base, got[2].first_word) == (1, 0)
    assert got[3].n_base == 0 and got[3].labels == "gpl-3" and got[3].spans[0].end - got[3].spans[0].start == 9
    assert got[4].labels == "" and got[5].n_base == 0


def test_license_spans_repeat_short_phrases_count_and_chains_reach_back():
    long = " ".join(f"u{i} v{i} w{i} all rights reserved here" for i in range(90))
    scanner = licenses.Scanner((("x", "ab cd"),), (("mpl", "subject to the terms of the mozilla public license"), ("long", long)))
    header = b"subject to the terms of the mozilla public license".split()
    _, spans = scanner.scan(header + [b"code"] * 20 + header + header[:3] + header)
    assert spans == [(1, 0, 9, 1.0), (1, 29, 38, 1.0), (1, 41, 50, 1.0)]
    assert scanner.scan([b"q", b"ab", b"cd", b"q"])[0] == [(0, 1)]
    gapped = " ".join(f"u{i} v{i} w{i} q all rights reserved here q" for i in range(90)).encode().split()
    assert [x for x in scanner.scan(gapped)[1]] == [(2, 0, len(gapped) - 1, 1.0)]
    assert len(scanner.scan(header * 2000)[1]) == 2000


SCANNER = licenses.Scanner(licenses.PHRASES, licenses.read_templates())


def labels_of(text):
    _, spans = SCANNER.scan(licenses.words(text))
    return {SCANNER.labels[x[0]] for x in SCANNER.named(spans)}


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", {"cc-by"}),
        ("a Creative Commons Attribution-NonCommercial 4.0 International License", {"cc-by-nc"}),
        ("a Creative Commons Attribution-NoDerivatives 4.0 International License", {"cc-by-nd"}),
        ("a Creative Commons Attribution-ShareAlike 4.0 International License", {"cc-by-sa"}),
        ("a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", {"cc-by-nc-sa"}),
        ("a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", {"cc-by-nc-nd"}),
        ("licensed under the GNU General Public License version 1", {"gpl-1"}),
        ("licensed under the GNU General Public License version 3 or later", {"gpl-3"}),
        ("licensed under the GNU General Public License version of your choice", {"gpl"}),
        ("THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.", {"mit"}),
        ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", {"bsd"}),
        ("the license of this general text is public and free", set()),
        ("SPDX-License-Identifier: MIT", {"mit"}),
        ("// SPDX-License-Identifier: GPL-3.0-or-later", {"gpl-3"}),
        ("SPDX-License-Identifier: CC-BY-NC-SA-4.0", {"cc-by-nc-sa"}),
        ("SPDX-License-Identifier: nobody knows", set()),
        ("Creative Commons Attribution 3.0 Unported", {"cc-by"}),
        ("shared as CC BY-SA 3.0", {"cc-by-sa"}),
        ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", {"gpl-3"}),
        ("under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", {"gpl-3"}),
        ("under the terms of the GNU General Public License, either version 2 of the License", {"gpl-2"}),
        ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", {"epl"}),
        ("Boost Software License - Version 1.0 - August 17th, 2003", {"boost"}),
        ("Distributed under the Boost Software License", {"boost"}),
        ("the general public may license what creative people attribute to the commons", set()),
        ("a public license of the eclipse, boosted by software", set()),
    ],
)
def test_only_the_license_that_explains_a_passage_best_is_named(text, labels):
    assert labels_of("some words before " + text + " and some after") == labels


def test_whole_licenses_with_words_left_out_and_put_in():
    rnd = random.Random(5)
    whole = [(x, licenses.words(t)) for x, t in licenses.read_templates() if len(licenses.words(t)) > 90]
    assert {x for x, _ in whole} >= {"mit", "bsd", "isc", "zlib", "unlicense", "boost"}
    for label, tokens in whole:
        assert label in labels_of(" ".join(t.decode() for t in tokens))
        at = rnd.randrange(10, len(tokens) - 50)
        cut = [*tokens[:at], *tokens[at + len(tokens) // 8 :]]  # an eighth is left out at once
        cut[3:3] = [b"acme", b"inc"]
        assert label in labels_of(" ".join(t.decode() for t in cut)), label


def slow_chain(tokens, template, jump):
    """Most template words that a forward chain of maximal common runs covers, by trying all of them in order."""
    runs = [(i + n, j + n, n) for i in range(len(tokens)) for j in range(len(template)) if (i == 0 or j == 0 or tokens[i - 1] != template[j - 1]) for n in [next((k for k in range(min(len(tokens) - i, len(template) - j) + 1) if k == min(len(tokens) - i, len(template) - j) or tokens[i + k] != template[j + k]))] if n >= licenses.MIN_MATCH]
    best = {}
    for m in sorted(runs):
        best[m] = m[2]
        for p in best:
            if p != m and p[0] <= m[0] and p[1] < m[1] and p[0] >= m[0] - m[2] - licenses.MAX_GAP and m[1] - m[2] - p[1] <= jump:
                over = max(0, p[0] - (m[0] - m[2]), p[1] - (m[1] - m[2]))
                if over < m[2]:
                    best[m] = max(best[m], best[p] + m[2] - over)
    return max(best.values(), default=0)


def test_chains_and_scores_against_brute_force():
    rnd = random.Random(21)
    seen = 0
    for _ in range(120):
        template = [f"t{rnd.randrange(30)}" for _ in range(rnd.randrange(6, 60))]
        tokens = []
        for t in template:
            if rnd.random() < 0.12:
                tokens += [f"x{rnd.randrange(5)}"] * rnd.randrange(1, 12)
            if rnd.random() > 0.08:
                tokens.append(t)
        scanner = licenses.Scanner((), [("one", " ".join(template))])
        _, spans = scanner.scan([t.encode() for t in tokens])
        got = max((x[3] for x in spans), default=0.0)
        want = min(1.0, slow_chain(tokens, template, scanner.jumps[0]) / len(template))
        assert got == pytest.approx(want)
        seen += want >= licenses.MIN_SHARE
    assert seen > 20


def test_matching_statistics_against_brute_force():
    rnd = random.Random(8)
    for _ in range(60):
        alphabet = [b"a", b"b", b"c", b"d"][: rnd.randrange(2, 5)]
        sequences = [[rnd.choice(alphabet) for _ in range(rnd.randrange(1, 12))] for _ in range(rnd.randrange(1, 5))]
        tokens = [rnd.choice([*alphabet, b"x"]) for _ in range(40)]
        known = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        automaton = licenses.Automaton(sequences)
        for i, (state, length) in enumerate(automaton.statistics(tokens), 1):
            assert length == max(n for n in range(i + 1) if n == 0 or tuple(tokens[i - n : i]) in known)
            if length:
                ends = {(s, e) for s, q in enumerate(sequences) for e in range(length, len(q) + 1) if q[e - length : e] == tokens[i - length : i]}
                assert ends <= set(automaton.ends[state])


def plain_kernel(a, b):
    """Common subsequences of four letters of two words (with ends), each occurrence weighted by the span it takes."""
    def maps(word):
        out = collections.Counter()
        letters = toxicity._codes(f"\x01{word}\x02").tolist()
        for p in itertools.combinations(range(len(letters)), 4):
            if p[3] - p[0] < toxicity.SPAN:
                out[tuple(letters[k] for k in p)] += toxicity.DECAY ** (p[3] - p[0] + 1)
        return out

    x, y = maps(a), maps(b)
    size = lambda m: sum(v * v for v in m.values()) ** 0.5
    return sum(v * y[k] for k, v in x.items()) / (size(x) * size(y)) if x and y else 0.0


def test_subsequence_kernel_against_brute_force():
    rnd = random.Random(4)
    words = ["idiot", "id-iot", "i.d.i.o.t", "worthless", "wörthless", "loser", "closer", "ab", *["".join(rnd.choice("abcdé") for _ in range(rnd.randrange(3, 12))) for _ in range(30)]]
    marks = ["idiot", "worthless", "abcd", "loser"]
    got = toxicity.Landmarks(marks).kernel(words)
    for i, word in enumerate(words):
        for j, mark in enumerate(marks):
            assert abs(got[i, j] - plain_kernel(word, mark)) < 1e-5


def test_every_place_of_a_phrase_is_found_in_random_texts():
    rnd = random.Random(8)
    scanner = SCANNER
    vocabulary = "the mit license apache version 2 cc by nc under licensed other".split()
    phrases = [(k, p.encode().split()) for k, (_, p) in enumerate(licenses.PHRASES)]
    for _ in range(300):
        tokens = [w.encode() for w in rnd.choices(vocabulary, k=40)]
        want = {(k, i) for k, p in phrases for i in range(40) if tokens[i : i + len(p)] == p}
        assert set(scanner.scan(tokens)[0]) == want


def test_license_query_counts_the_phrases_it_is_given_in_texts_of_any_bytes(spark, tmp_path):
    from sparkfolio.llm import queries

    rnd = random.Random(12)
    given = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    pieces = [*given, "Under The", "MIT-License", "the mit license", "Apache License, Version 2.0", "CC-BY", "nc", "by nc", "é", "x", "under"]
    texts = [None, "", "under the mit licenseé", "the mit license", "cc by nc by nc cc by nc"]
    texts += ["".join(rnd.choice(pieces) + rnd.choice([" ", "\n", "\x00", "\x7f", ", ", "\u00a0"]) for _ in range(rnd.randrange(12))) for _ in range(200)]
    raw = [t if t is None else t.encode() for t in texts] + [b"\xff under the mit license, cc by nc \xfe", b"cc by nc\xe9"]
    rows = spark.createDataFrame(list(enumerate(raw)), "doc_id long, text binary")
    rows.withColumn("text", rows["text"].cast("string")).write.parquet(str(tmp_path / "documents.parquet"))
    got = by_id(queries.op4_license_scan(spark, str(tmp_path)))
    assert len(got) == len(raw)
    for i, t in enumerate(raw):
        tokens = [x.lower() for x in re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or b"")]
        places = sorted((k, label) for phrase, label in given.items() for k in range(len(tokens)) if tokens[k : k + len(phrase.split())] == phrase.encode().split())
        first, last = (places[0][0], places[-1][0]) if places else (None, None)
        want = (len(tokens), len(places), first, last, ",".join(sorted({x for _, x in places})))
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels) == want, t
        assert set(want[4].split(",")) - {""} <= set(got[i].labels.split(","))
    assert (got[3].n_base, got[3].labels, got[3].score) == (0, "mit", 1.0)  # a template, no phrase


def test_page_layout(spark):
    html = "<head><title>t</title></head><p>One<p>Two <b>bold</b><ul><li>a<li>b<ol><li>x<li>y</ol></ul><table><tr><th>Name<th>N<tr><td>Al<td>12</table><div hidden>no</div><div style='display: none'>no</div><pre>a\n\n  b</pre><script>x<p></script>end<br>&amp; more"
    assert html_text.page_text(html) == "One\n\nTwo bold\n\n- a\n- b\n  1. x\n  2. y\n\nName  N\nAl    12\n\na\n\n  b\n\nend\n& more"
    deep = "<div>" * 50_000 + "x" + "<b <i <" * 2000
    pages = spark.createDataFrame([(1, "u", html), (2, None, None), (3, "v", ""), (4, "w", deep)], "page_id long, url string, html string")
    got = by_id(html_text.extract_text(pages), "page_id")
    assert got[2].text is None and got[3].text == "" and got[4].text.startswith("x") and html_text.extract_text(pages.limit(0)).count() == 0


def test_tags_of_any_length_and_stray_quotes():
    long = "A" * 200_000
    assert html_text.page_text(f'<p>a</p><img src="data:image/png;base64,{long}"><p>b</p>') == "a\n\nb"
    assert html_text.page_text(f"<div data-x='{long}' hidden>no</div><div style=\"color: red; background: url({long}); display: none\">no</div>yes") == "yes"
    assert html_text.page_text("<a title=it's href=x>link</a><p>visible text</p><a title=that's>") == "link\n\nvisible text"
    assert html_text.page_text("""<p title="a > b" class='x"y'>one<a href=/x/>two</a> 3 < 4 <b data-a= "q>" c>five</b><i =a "b>six""") == "onetwo 3 < 4 fivesix"
    assert html_text.page_text("a<!-->b<!--x--!>c</>d</ e>f<!-- g") == "abcdf"
    assert html_text.page_text("<a " + "b='" * 100_000) == "" and html_text.page_text("<a b=" * 100_000) == ""


def test_formulas_labels_options_and_aria_hidden_are_shown():
    assert html_text.page_text("<p>so <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>tex</annotation></math> holds") == "so x=1 2 holds"
    svg = "<svg><title/><title>no</title><defs><text>no</text></defs><style>no{}</style><g><path d='M0'/><text>North</text><text><![CDATA[So & so]]></text></g><desc>no</desc></svg>"
    assert html_text.page_text(f"a{svg}<p>b") == "a\nNorth\nSo & so\n\nb"
    assert html_text.page_text("<svg><defs><p>out</p>in") == "out\n\nin" and html_text.page_text("<svg><foreignObject><p>f</p></foreignObject></svg>g<svg/>h") == "f\n\ngh"
    options = "<p>Pick <select><option>one<option label=two>2<optgroup label=More><option>three</select> now<datalist><option>no</datalist>"
    assert html_text.page_text(options) == "Pick\none\ntwo\nMore\nthree\nnow"
    assert html_text.page_text("<p aria-hidden=true>seen</p><p hidden>no</p>") == "seen"


def test_elements_of_any_depth_keep_their_ancestors_rules():
    deep = "<div>" * 30_000
    assert html_text.page_text(f"{deep}seen<span hidden>{'<b>' * 5000}lost</span>end") == "seenend"
    assert html_text.page_text("<ul><li>" * 3000 + "x").endswith("x")
    assert html_text.page_text("<p>" + "<b>" * 20_000 + "a<p>b" * 2000).count("b") == 2000
    assert html_text.page_text("a<br><br>b<pre>c<br><br>d</pre>") == "a\n\nb\n\nc\n\nd"


def test_cells_over_several_columns_and_rows_keep_the_others_in_place():
    html = "<table><tr><th>k<th colspan=2>both<th>end<tr><td rowspan=2>r<td>a<td>b<td>c<tr><td>d<td>e<td>f</table>"
    assert html_text.page_text(html) == "k  both  end\nr  a  b  c\n   d  e  f"
    groups = "<table><tbody><tr><td rowspan=0>all<td>x<tr><td>y<tbody><tr><td>new<td>z</table>"
    assert html_text.page_text(groups) == "all  x\n     y\nnew  z"
    assert html_text.page_text("<table><tr><td colspan=1000>a long title<td>t<tr><td>1<td>2</table>") == "a long title  t\n1  2"


def test_toxicity_holds_out_and_tolerates_gaps(spark):
    rnd = random.Random(10)
    words = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randrange(3, 9))) for _ in range(300)]
    bad = ["idiot", "moron", "worthless", "disgusting"]
    rows = []
    for i in range(600):
        text = rnd.choices(words, k=40)
        if i % 4 == 0:
            text[rnd.randrange(40)] = rnd.choice(bad)
        rows.append((i, " ".join(text) + ".", int(i % 4 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int"))
    got = by_id(toxicity.score(docs, model))
    held = [i for i, r in got.items() if r.held_out]
    assert held and all(zlib.crc32(str(i).encode()) % 4 == 2 for i in held)
    assert sum(got[i].predicted == rows[i][2] for i in held) / len(held) > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "you worthl-ess thing"), (4, "a plain line"), (None, "id.iot")], "doc_id long, text string")
    scored = by_id(toxicity.score(odd, model))
    assert scored[1].score == scored[2].score < 0.3 and scored[3].score > scored[4].score and not scored[None].held_out
    empty = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(odd, empty).count() == 5


def test_toxicity_reads_gaps_of_any_length_and_spelled_words(spark):
    rnd = random.Random(11)
    words = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randrange(3, 9))) for _ in range(300)]
    bad = ["idiot", "moron", "worthless", "disgusting"]
    gaps = ["", "-", "--", "...", "_1_*", " ", "  ", " - "]
    rows = []
    for i in range(600):
        text = rnd.choices(words, k=40)
        if i % 4 == 0:
            text[rnd.randrange(40)] = rnd.choice(gaps).join(rnd.choice(bad))
        rows.append((i, " ".join(text) + ".", int(i % 4 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int"))
    clean = [r[1] for r in rows if not r[2]][:12]
    forms = [f"{c} {gap.join(w)} {c}" for w, c in zip(bad * 3, clean, strict=True) for gap in ("--", "...", "-/|~", " ", "  ", " . ", "\n")]
    forms += ["y o u a r e a n i d i o t", "you.are.an.idiot", "a b c d e " * 2000 + "m--o--r--o--n"]
    plain = [*clean, "a b c d e " * 2000, "plan a, b or c", None, ""]
    got = by_id(toxicity.score(spark.createDataFrame(list(enumerate(forms + plain)), "doc_id long, text string"), model))
    assert [f for i, f in enumerate(forms) if not got[i].predicted] == []
    assert [p for i, p in enumerate(plain, len(forms)) if got[i].predicted] == []


def test_digests_are_of_whole_texts(spark):
    from sparkfolio.llm import queries

    assert set(queries.SQL) <= set(queries.QUERIES) and len(queries.QUERIES) == 13
    assert re.fullmatch("[0-9a-f]{64}", hashlib.sha256(b"").hexdigest())
