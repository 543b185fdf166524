"""License scans with a generalised suffix automaton of license tokens.

The automaton holds every substring of all templates.  A file is streamed through it for its matching statistics (the
longest suffix at each token that some template holds); maximal matches are chained along a template into spans, and a
template that is covered far enough gives its label.  Phrases are templates of their own whose every place counts.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases whose every place counts, with their labels, unless a caller has others.
PHRASES = (
    ("mit", "the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Passages of licenses with their labels: names, tags, notices, and whole short licenses and their parts.
TEMPLATE_FILE = Path(__file__).with_name("templates.tsv")
MIN_MATCH, MAX_GAP, MIN_SHARE, MIN_COVERED = 3, 8, 0.8, 5

#: ASCII letters in lower case, digits and all beyond ASCII stay; the rest of ASCII separates words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def read_templates(path: str | Path = TEMPLATE_FILE) -> list[tuple[str, str]]:
    """(label, passage) of each line of a file, a tab between them."""
    with open(path, encoding="utf-8") as f:
        return [tuple(line.rstrip("\n").split("\t", 1)) for line in f if "\t" in line]


def words(text: str | bytes | None) -> list[bytes]:
    """Words of a text as bytes, UTF-8 or not, A-Z in lower case."""
    raw = text.encode("utf-8", "replace") if isinstance(text, str) else text
    return raw.translate(_WORDS).split() if raw else []


@dataclass
class Match:
    """``length`` tokens that end before ``end`` in the file and before ``at`` in the template."""

    end: int
    at: int
    length: int


class Automaton:
    """Suffix automaton of several token sequences."""

    def __init__(self, sequences: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.len = [-1], [0]
        own: list[list[tuple[int, int]]] = [[]]
        for s, tokens in enumerate(sequences):
            last = 0
            for i, token in enumerate(tokens):
                last = self._extend(last, token)
                while len(own) < len(self.len):
                    own.append([])
                own[last].append((s, i + 1))
        #: for each state, where its strings end: (sequence, place), gathered from the longest to the shortest
        self.ends = [list(x) for x in own]
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            self.ends[self.link[v]] += self.ends[v]

    def _state(self, length: int, following: dict[bytes, int], link: int) -> int:
        self.len.append(length)
        self.next.append(following)
        self.link.append(link)
        return len(self.len) - 1

    def _extend(self, last: int, token: bytes) -> int:
        if token in self.next[last]:
            return self._fitting(last, self.next[last][token], token)
        new, p = self._state(self.len[last] + 1, {}, 0), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._fitting(p, self.next[p][token], token)
        return new

    def _fitting(self, p: int, q: int, token: bytes) -> int:
        """The state of exactly one token more than ``p``: ``q`` itself, or a copy of it that takes over the shorter strings."""
        if self.len[q] == self.len[p] + 1:
            return q
        copy = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        return copy

    def statistics(self, tokens: list[bytes]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest known suffix at each token."""
        state = length = 0
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            if token in self.next[state]:
                state = self.next[state][token]
                length += 1
            else:
                length = 0
            yield state, length


class Scanner:
    """Scans token lists for phrases and templates."""

    def __init__(self, phrases, templates):
        self.labels = [x for x, _ in (*phrases, *templates)]
        sequences = [words(t) for _, t in (*phrases, *templates)]
        self.lengths, self.n_phrases = [len(s) for s in sequences], len(phrases)
        self.automaton = Automaton(sequences)
        #: words in a row that a stretch needs: for a match, or for the shortest phrase
        self.least = min([MIN_MATCH, *self.lengths[: self.n_phrases]])
        self.vocabulary = {t for s in sequences for t in s}
        #: template words that a chain may leave out at once: all that it may leave out at all, in long templates
        self.jumps = [max(4 * MAX_GAP, int((1 - MIN_SHARE) * n)) for n in self.lengths]
        self.held: dict[int, dict[int, tuple[int, list[int]]]] = {}
        #: for each state, the phrases that are suffixes of its longest string
        self.whole: list[list[int]] = [[] for _ in self.automaton.len]
        for s, tokens in enumerate(sequences[: self.n_phrases]):
            *_, (state, _) = self.automaton.statistics(tokens)
            self.whole[state].append(s)
        for v in sorted(range(1, len(self.whole)), key=self.automaton.len.__getitem__):
            self.whole[v] = self.whole[v] + self.whole[self.automaton.link[v]]

    def scan(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, float]]]:
        """Places of phrases (phrase, start), and covered template spans (template, start, end, share)."""
        vocabulary = self.vocabulary
        known = np.array([i for i, w in enumerate(tokens) if w in vocabulary], dtype=np.int64)
        places: list[tuple[int, int]] = []
        matches: dict[int, list[Match]] = defaultdict(list)
        if len(known) >= self.least:
            cut = np.flatnonzero(np.diff(known) != 1) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(known)], strict=True):
                if hi - lo >= self.least:  # elsewhere no match can be long enough
                    self._stretch(tokens[known[lo] : known[hi - 1] + 1], int(known[lo]), places, matches)
        spans = [x for s, found in matches.items() for x in self._chains(s, found)]
        return places, spans

    def _held(self, state: int) -> dict[int, tuple[int, list[int]]]:
        """For each template that holds a suffix of the state's longest string: the longest such suffix, and where it ends there."""
        if state not in self.held:
            found: dict[int, tuple[int, list[int]]] = {}
            v = state
            while v > 0 and self.automaton.len[v] >= MIN_MATCH:
                new: dict[int, list[int]] = defaultdict(list)
                for s, at in self.automaton.ends[v]:
                    if s >= self.n_phrases and s not in found:
                        new[s].append(at)
                found |= {s: (self.automaton.len[v], ats) for s, ats in new.items()}
                v = self.automaton.link[v]
            self.held[state] = found
        return self.held[state]

    def _stretch(self, tokens, base, places, matches):
        before: dict[int, tuple[int, list[int]]] = {}
        for i, (state, length) in enumerate([*self.automaton.statistics(tokens), (0, 0)]):
            for s in self.whole[state]:
                if self.lengths[s] <= length:
                    places.append((s, base + i + 1 - self.lengths[s]))
            now = {s: (min(n, length), ats) for s, (n, ats) in self._held(state).items()} if length >= MIN_MATCH else {}
            for s, (n, ats) in before.items():
                if now.get(s, (0,))[0] != n + 1:  # this template's match can't be made longer
                    matches[s].extend(Match(base + i, at, n) for at in ats if at >= n)
            before = now

    def _chains(self, s: int, found: list[Match]) -> list[tuple[int, int, int, float]]:
        """Chains of matches for template ``s`` that do not overlap, larger ones first taken: all that cover ``MIN_SHARE``, or else the best one."""
        spans, parts = [], [found]
        while parts:
            part = parts.pop()
            kept: list[tuple[int, int]] = []
            for covered, start, end in sorted(self._covered(part, self.jumps[s]), key=lambda x: (-x[0], x[2])):
                share = min(1.0, covered / self.lengths[s])
                if share < MIN_SHARE and spans:
                    break
                if not _overlaps(kept, start, end):
                    insort(kept, (start, end))
                    spans.append((s, start, end, share))
            if spans[0][3] < MIN_SHARE:
                break
            rest: dict[int, list[Match]] = defaultdict(list)  # what lies between the chains taken
            for m in part:
                if kept and not _overlaps(kept, m.end - m.length, m.end):
                    rest[bisect_right(kept, (m.end,))].append(m)
            parts += [x for x in rest.values() if sum(m.length for m in x) >= MIN_SHARE * self.lengths[s]]
        return sorted(spans)

    def _covered(self, found: list[Match], most: int) -> list[tuple[int, int, int]]:
        """For each match the chain up to it that covers most, forward in file and template with small gaps: (covered, start, end)."""
        best: list[tuple[int, int, int]] = []
        for k, m in enumerate(found):
            own, first = (m.length, m.end - m.length, m.end), m.end - m.length - MAX_GAP
            for j in range(k - 1, -1, -1):
                p, c = found[j], best[j]
                if p.end < first:  # matches are in the order of their ends
                    break
                gap, jump = m.end - m.length - p.end, m.at - m.length - p.at
                over = max(0, -gap, -jump)
                if jump <= most and over < m.length and m.at > p.at and c[0] + m.length - over > own[0]:
                    own = (c[0] + m.length - over, c[1], m.end)
            best.append(own)
        return best


    def named(self, spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
        """The spans that give labels: enough of the template, five words of it or all, and no template of another label explains the place better."""
        enough = [x for x in spans if x[3] >= MIN_SHARE and x[3] * self.lengths[x[0]] >= min(MIN_COVERED, self.lengths[x[0]]) - 1e-9]
        return unrivalled(enough, self.labels, self.lengths)


def _overlaps(kept: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether a place meets one of ``kept``, which are apart and in order."""
    k = bisect_right(kept, (start, end))
    return k > 0 and kept[k - 1][1] > start or k < len(kept) and kept[k][0] < end


def unrivalled(spans: list[tuple[int, int, int, float]], labels: list[str], lengths: list[int]) -> list[tuple[int, int, int, float]]:
    """The spans (template, start, end, share) that no template of another label explains better.

    Of spans that share more than half of the shorter one's words, the one of the larger share stays, then the one that
    covers more words; where labels tie, the passage does not tell them apart, and none of them stays.
    """
    order = lambda x: (-x[3], -round(x[3] * lengths[x[0]]))
    kept: list[tuple[int, int, int, float]] = []
    for _, group in groupby(sorted(spans, key=order), key=order):
        free = [x for x in group if not any(labels[x[0]] != labels[k[0]] and _shared(x, k) for k in kept)]
        kept += [x for x in free if not any(labels[x[0]] != labels[y[0]] and _shared(x, y) for y in free)]
    return sorted(kept)


def _shared(x: tuple, y: tuple) -> bool:
    """Whether two spans share more than half of the shorter one."""
    return 2 * (min(x[2], y[2]) - max(x[1], y[1])) > min(x[2] - x[1], y[2] - y[1])


def scan_licenses(docs: DataFrame, phrases=PHRASES, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``spans`` are (label, start, end, share) in words for every place where at least ``MIN_SHARE`` of a template is covered
    and no template of another label explains the place better (:func:`unrivalled`); ``score`` is the largest share, 1 where
    a phrase stands.

    * Null and empty texts have no words, no places (first_word and last_word null) and empty labels.
    * Texts are read as bytes; those that are no valid UTF-8 are scanned like others, their bytes beyond ASCII parts of words.
    * Rows are scanned one by one: repeated rows and null ids come back as they are; other columns are ignored.
    * A stretch of a file is only streamed where as many words in a row are license words as a match (``MIN_MATCH``) or the
      shortest phrase needs.
    """
    templates = read_templates() if templates is None else templates
    span = "array<struct<label:string,start:long,end:long,share:double>>"
    schema = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {span}"
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = words(text.as_py())
                places, spans = scanner.scan(tokens)
                starts = [at for _, at in places]
                base = {scanner.labels[s] for s, _ in places}
                covered = scanner.named(spans)
                labels = base | {scanner.labels[x[0]] for x in covered}
                score = 1.0 if places else max((x[3] for x in spans), default=0.0)
                rows = [{"label": scanner.labels[s], "start": a, "end": b, "share": share} for s, a, b, share in covered]
                first, last = (min(starts), max(starts)) if starts else (None, None)
                out.append((doc, len(tokens), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, rows))
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, schema)
