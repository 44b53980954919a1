"""License notices by template markup.

A template is the wording of a licence with two kinds of regions marked in it:

``<<beginOptional>> ... <<endOptional>>``
    wording that may be missing; optional regions may hold others,
``<<var;name="...";words="LOW-HIGH";match="...">>``
    LOW to HIGH words that may be anything, or that each match a regular expression.

Everything else is mandatory and has to be there word by word; case, punctuation and
line breaks do not count.  All templates are compiled into one automaton over words
that is made deterministic while it runs: only the sets of states that texts reach are
ever built.  It runs from the words that can start a template, not from every word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortsmith.llm.features import parts
from cohortsmith.llm.license_texts import PHRASES, TEMPLATES
from cohortsmith.llm.tables import column
from cohortsmith.llm.words import words

TAG = re.compile(r"<<(.*?)>>", re.DOTALL)
ATTRIBUTE = re.compile(r'(\w+)="([^"]*)"')

# Sets of states and steps a worker remembers before it starts afresh.
REMEMBERED = 200_000

# How sure a text is: a whole template, or only a phrase.
SURE, HINT = 1.0, 0.5


@dataclass(frozen=True)
class Word:
    text: str


@dataclass(frozen=True)
class Optional:
    inner: tuple


@dataclass(frozen=True)
class Region:
    low: int
    high: int
    match: str | None


def parse(markup: str) -> tuple:
    """The template as a sequence of words, optional parts and replaceable regions."""
    open_parts: list[list] = [[]]
    for at, piece in enumerate(TAG.split(markup)):
        if at % 2 == 0:
            found, _ = words(pa.array([piece]))
            open_parts[-1] += [Word(w) for w in found.to_pylist()]
        elif piece == "beginOptional":
            open_parts.append([])
        elif piece == "endOptional" and len(open_parts) > 1:
            inner = tuple(open_parts.pop())
            open_parts[-1].append(Optional(inner))
        elif piece.split(";")[0] == "var":
            given = dict(ATTRIBUTE.findall(piece))
            low, high = map(int, given.get("words", "1-1").split("-"))
            if not 0 <= low <= high:
                raise ValueError(f"a region of {low} to {high} words")
            open_parts[-1].append(Region(low, high, given.get("match")))
        else:
            raise ValueError(f"unknown or unopened tag <<{piece}>>")
    if len(open_parts) > 1:
        raise ValueError("an optional part is not closed")
    return tuple(open_parts[0])


@dataclass
class Automaton:
    """All templates at once; states are numbers, sets of states are numbered too."""

    labels: list[str] = field(default_factory=list)
    vocabulary: dict[str, int] = field(default_factory=dict)
    patterns: dict[str, re.Pattern] = field(default_factory=dict)
    starts: list[int] = field(default_factory=list)
    by_word: list[dict[int, int]] = field(default_factory=list)
    by_any: list[tuple[int, int] | None] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    accepts: dict[int, int] = field(default_factory=dict)

    def _state(self) -> int:
        self.by_word.append({})
        self.by_any.append(None)
        self.free.append([])
        return len(self.free) - 1

    def word_id(self, word: str) -> int:
        return self.vocabulary.setdefault(word, len(self.vocabulary))

    def _attach(self, nodes: Sequence, state: int) -> int:
        """States for the nodes after ``state``; returns the last one."""
        for node in nodes:
            following = self._state()
            if isinstance(node, Word):
                self.by_word[state][self.word_id(node.text)] = following
            elif isinstance(node, Optional):
                self.free[self._attach(node.inner, state)].append(following)
                self.free[state].append(following)
            else:
                pattern = -1
                if node.match is not None:
                    self.patterns.setdefault(node.match, re.compile(node.match))
                    pattern = list(self.patterns).index(node.match)
                for step in range(node.high):
                    if step >= node.low:
                        self.free[state].append(following)
                    after = following if step + 1 == node.high else self._state()
                    self.by_any[state] = (pattern, after)
                    state = after
                if node.high == 0:
                    self.free[state].append(following)
            state = following
        return state

    def add(self, label: str, markup: str) -> None:
        start = self._state()
        self.labels.append(label)
        # A step of its own, so that optional parts at the start stay apart.
        first = self._state()
        self.free[start].append(first)
        self.accepts[self._attach(parse(markup), first)] = len(self.labels) - 1
        self.starts.append(start)

    def fits(self, word: str) -> int:
        """Bit i tells whether the word matches pattern i."""
        tests = self.patterns.values()
        return sum((p.fullmatch(word) is not None) << k for k, p in enumerate(tests))

    def finish(self) -> Automaton:
        self.known_fits = [self.fits(word) for word in self.vocabulary]
        self.forget()
        if self.accepted[0]:
            raise ValueError("a template without mandatory words")
        # Which word can follow which at the start of a template; None for any word.
        self.firsts: dict[int, set[int] | None] = {}
        for state in self.sets[0]:
            if self.by_any[state] is not None:
                raise ValueError("a template has to start with a word")
            for word, target in self.by_word[state].items():
                after = self._closure([target])
                known = self.firsts.setdefault(word, set())
                if known is None or any(
                    s in self.accepts or self.by_any[s] is not None for s in after
                ):
                    self.firsts[word] = None
                else:
                    known.update(w for s in after for w in self.by_word[s])
        return self

    def forget(self) -> None:
        self.sets: list[tuple[int, ...]] = []
        self.accepted: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.steps: dict[tuple[int, int], int] = {}
        self._numbered(self._closure(self.starts))

    def _closure(self, states: Sequence[int]) -> tuple[int, ...]:
        seen, waiting = set(states), list(states)
        while waiting:
            for other in self.free[waiting.pop()]:
                if other not in seen:
                    seen.add(other)
                    waiting.append(other)
        return tuple(sorted(seen))

    def _numbered(self, states: tuple[int, ...]) -> int:
        at = self.number.get(states)
        if at is None:
            at = self.number[states] = len(self.sets)
            self.sets.append(states)
            self.accepted.append(tuple(self.accepts[s] for s in states if s in self.accepts))
        return at

    def step(self, at: int, symbol: int) -> int:
        """The set of states after a word, -1 if none is left.

        A word of the vocabulary is its number, any other -1 minus what it fits.
        """
        known = self.steps.get((at, symbol))
        if known is None:
            word = max(symbol, -1)
            fits = self.known_fits[symbol] if symbol >= 0 else -1 - symbol
            reached = []
            for state in self.sets[at]:
                if word in self.by_word[state]:
                    reached.append(self.by_word[state][word])
                if (some := self.by_any[state]) is not None:
                    if some[0] < 0 or fits >> some[0] & 1:
                        reached.append(some[1])
            known = self._numbered(self._closure(reached)) if reached else -1
            self.steps[at, symbol] = known
        return known

    def longest(self, ids, word_at, start: int, end: int) -> dict[int, int]:
        """Templates that accept words from ``start`` on: number to the last word's place."""
        if len(self.sets) + len(self.steps) > REMEMBERED:
            self.forget()
        at, found = 0, {}
        for i in range(start, end):
            at = self.step(at, ids[i] if ids[i] >= 0 else -1 - self.fits(word_at(i)))
            if at < 0:
                break
            for template in self.accepted[at]:
                found[template] = i
        return found


def compiled(templates: Sequence[tuple[str, str]]) -> Automaton:
    automaton = Automaton()
    for label, markup in templates:
        automaton.add(label, markup)
    return automaton.finish()


def _phrase_places(
    phrases: Mapping[str, str], automaton: Automaton
) -> list[tuple[str, list[int]]]:
    out = []
    for phrase, label in phrases.items():
        found, _ = words(pa.array([phrase]))
        out.append((label, [automaton.word_id(w) for w in found.to_pylist()]))
    return out


class Scanner:
    """Places of phrases and templates in slices of texts, for one task."""

    def __init__(self, templates, phrases):
        self.automaton = compiled(templates)
        self.phrases = _phrase_places(phrases, self.automaton)
        self.vocabulary = pa.array(list(self.automaton.vocabulary), pa.large_string())
        self.first = np.zeros(len(self.vocabulary) + 1, bool)
        self.first[list(self.automaton.firsts)] = True
        size = len(self.vocabulary) + 1
        self.pairs, self.alone = [], np.zeros(size, bool)
        for word, after in self.automaton.firsts.items():
            if after is None:
                self.alone[word] = True
            else:
                self.pairs += [word * size + other for other in after]
        self.pairs = np.array(sorted(self.pairs), np.int64)

    def places(self, texts: pa.Array) -> tuple[np.ndarray, list[list[tuple]]]:
        """Words per text, and its places ``(label, template?, first word, last word)``."""
        found, ends = words(texts)
        begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        out: list[list[tuple]] = [[] for _ in range(len(ends))]
        ids = pc.fill_null(pc.index_in(found, value_set=self.vocabulary), -1)
        ids = ids.to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(ends)), ends - begins)
        for label, phrase in self.phrases:
            at = np.flatnonzero(ids == phrase[0])
            at = at[at + len(phrase) <= len(ids)]
            for k, word in enumerate(phrase[1:], 1):
                at = at[(ids[at + k] == word) & (owner[at + k] == owner[at])]
            for i in at.tolist():
                t = int(owner[i])
                out[t].append((label, False, i - int(begins[t]),
                               i - int(begins[t]) + len(phrase) - 1))
        starts = np.flatnonzero((ids >= 0) & self.first[ids])
        following = np.append(ids, -1)[starts + 1]
        pair = ids[starts] * (len(self.vocabulary) + 1) + following
        starts = starts[
            self.alone[ids[starts]] | ((following >= 0) & np.isin(pair, self.pairs))
        ]
        reached: dict[tuple[int, int], int] = {}
        listed = ids.tolist() if len(starts) else []
        for i in starts.tolist():
            t = int(owner[i])
            matches = self.automaton.longest(
                listed, lambda k: found[k].as_py(), i, int(ends[t])
            )
            for template, last in matches.items():
                if i > reached.get((t, template), -1):  # places of a template are apart
                    reached[t, template] = last
                    out[t].append((
                        self.automaton.labels[template], True,
                        i - int(begins[t]), last - int(begins[t]),
                    ))
        return ends - begins, out


def scan(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Places of license wording in every text.

    Returns ``id_column``, ``n_words``, ``score`` (1 if a template is accepted, 0.5 if
    there is a phrase only, else 0), ``covered`` (share of the words inside a place) and
    ``places``: label, ``template`` (false for a phrase), first and last word, counted
    from 0, ordered by these.  Of places of one template that overlap the first stays;
    each is as long as the template allows.

    NULL and empty texts have no words and no places.  Rows are independent, so repeated
    rows give equal results; other columns do not matter, and an empty table gives an
    empty result.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(
        column(docs, id_column).alias("id"), column(docs, text_column).alias("text")
    )
    place = pa.struct([
        ("label", pa.string()), ("template", pa.bool_()),
        ("first_word", pa.int64()), ("last_word", pa.int64()),
    ])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        for batch in batches:
            for part in parts(batch, "text"):
                n, found = scanner.places(part.column("text"))
                score, covered, listed = [], [], []
                for size, places in zip(n.tolist(), found):
                    places.sort(key=lambda p: (p[2], p[3], p[1], p[0]))
                    score.append(
                        SURE if any(p[1] for p in places) else HINT if places else 0.0
                    )
                    inside, through = 0, -1
                    for _, _, first, last in places:
                        inside += max(0, last - max(first, through + 1) + 1)
                        through = max(through, last)
                    covered.append(inside / size if size else 0.0)
                    listed.append([
                        dict(zip(("label", "template", "first_word", "last_word"), p))
                        for p in places
                    ])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"), pa.array(n, pa.int64()),
                        pa.array(score, pa.float64()), pa.array(covered, pa.float64()),
                        pa.array(listed, pa.list_(place)),
                    ],
                    names=["id", "n_words", "score", "covered", "places"],
                )

    fields = (
        f"id {kind}, n_words long, score double, covered double, places array<struct"
        "<label:string,template:boolean,first_word:long,last_word:long>>"
    )
    return rows.mapInArrow(each, fields).withColumnRenamed("id", id_column)


def digest(scanned: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One flat row per text: phrase counts, their first and last start, sorted labels."""
    phrases = F.filter("places", lambda p: ~p["template"])
    starts = F.transform(phrases, lambda p: p["first_word"])

    def labels(places):
        names = F.transform(places, lambda p: p["label"])
        return F.array_join(F.array_sort(F.array_distinct(names)), ",")

    return scanned.select(
        column(scanned, id_column), "n_words", F.size(phrases).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(phrases).alias("base_labels"), labels(F.col("places")).alias("labels"), "score",
    )
