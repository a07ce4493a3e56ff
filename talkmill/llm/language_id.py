"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text. A text is then
parsed greedily against every automaton: a phrase is the longest stretch from
where the last one ended that occurs in that language's text, or one character
that does not. The fewer phrases a language needs for the text's characters, the
closer it is; the language with the fewest per character wins.

Letters are taken in lower case, and every run of other characters is one blank,
so marks and digits tell nothing. The parse begins anew every ``BLOCK``
characters: all blocks of an Arrow batch then step through the automata side by
side, one array look-up for each character and language, also for very long
texts. Documents are read where they are stored and nothing is shuffled.

Every label that has a text is learnt, each in a Spark task of its own, from at most
``ROWS_PER_LANGUAGE`` documents (smallest hash of the id), ``ROW_CHARACTERS``
characters of each and ``LANGUAGE_CHARACTERS`` in all. A language knows all letters
of its own text. Its moves are broadcast as sorted lists, 12 bytes each and at most
three for a character. Tasks write those of the ``COLUMNS`` most frequent letters out as
a table and look rarer ones up; tables beyond ``TABLE_BYTES`` are made anew for
each set of blocks, so memory does not grow with tables of many languages.

Defined results: a text that is null or has no letter is ``und`` with score 0, and so
is every text if nothing could be learnt. Equal phrase counts go to the language
with more labelled documents. The score is 1 minus the winner's phrases over the second's
(1 with one language only). Equal rows each give a row; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkmill.llm.common import take_columns
from talkmill.session import ship_package

UNKNOWN = "und"
BLOCK = 512
ROWS_PER_LANGUAGE = 64
ROW_CHARACTERS = 4_000
LANGUAGE_CHARACTERS = 60_000
# Symbols of a language with a column in its table: the blank, the unknown letter and its most frequent letters.
COLUMNS = 64
TABLE_BYTES = 192 << 20
# Blocks that are parsed side by side.
LANES = 1 << 13


class SuffixAutomaton:
    """All substrings of a sequence of small integers, as states and moves."""

    def __init__(self, symbols: list[int]):
        self.moves: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for symbol in symbols:
            new = len(length)
            self.moves.append({})
            length.append(length[last] + 1)
            link.append(0)
            at = last
            while at != -1 and symbol not in self.moves[at]:
                self.moves[at][symbol] = new
                at = link[at]
            if at != -1:
                target = self.moves[at][symbol]
                if length[target] == length[at] + 1:
                    link[new] = target
                else:
                    copy = len(length)
                    self.moves.append(dict(self.moves[target]))
                    length.append(length[at] + 1)
                    link.append(link[target])
                    while at != -1 and self.moves[at].get(symbol) == target:
                        self.moves[at][symbol] = copy
                        at = link[at]
                    link[target] = link[new] = copy
            last = new

    def sorted_moves(self) -> tuple[np.ndarray, np.ndarray]:
        """All moves as sorted keys, state * 2**32 + symbol, and the states they lead to."""
        found = sorted((state << 32 | symbol, to) for state, moves in enumerate(self.moves) for symbol, to in moves.items())
        return np.array([key for key, _ in found], np.int64), np.array([to for _, to in found], np.int32)


@dataclass
class Language:
    """A language's letters, the most frequent first, and the moves of its automaton.

    Symbol 0 is a blank, 1 a letter that the language does not know, 2 and more its letters.
    """

    name: str
    letters: str
    keys: np.ndarray
    targets: np.ndarray
    states: int

    def columns(self) -> int:
        return min(COLUMNS, len(self.letters) + 2)

    def first(self) -> np.ndarray:
        """The state in which a phrase begins for each symbol; the last state is that of a letter without moves."""
        out = np.full(len(self.letters) + 2, self.states, np.int32)
        begin = self.keys < 1 << 32
        out[self.keys[begin]] = self.targets[begin]
        return out

    def table(self) -> np.ndarray:
        """(states, columns) next states; where a phrase ends, minus one minus the state in which the next one begins."""
        first, width = self.first()[: self.columns()], self.columns()
        out = np.tile(-1 - first, (self.states + 1, 1))
        # a parse that begins has no phrase to end
        out[0] = first
        state, symbol = self.keys >> 32, self.keys & 0xFFFFFFFF
        low = symbol < width
        out[state[low], symbol[low]] = self.targets[low]
        return out

    def rare(self, state: np.ndarray, symbol: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The same as the table for symbols beyond its columns."""
        wanted = (state.astype(np.int64) << 32) | symbol
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        begins = first[symbol]
        return np.where(self.keys[at] == wanted, self.targets[at], np.where(state == 0, begins, -1 - begins))


def learn(name: str, rows: list[str], characters: int) -> Language:
    """A language from some of its text."""
    seen = Counter(c for row in rows for c in row.lower() if c.isalpha())
    letters = "".join(c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0])))
    alone = Model([Language(name, letters, np.zeros(0, np.int64), np.zeros(0, np.int32), 0)])
    own = alone.own_symbols(0)
    text = np.concatenate([own[alone.encode(row + " ")] for row in rows])[:characters]
    automaton = SuffixAutomaton(text.tolist())
    keys, targets = automaton.sorted_moves()
    return Language(name, letters, keys, targets, len(automaton.moves))


class Model:
    """The learnt languages, the one that wins a tie first."""

    def __init__(self, known: list[Language]):
        self.known = known
        self.languages = [language.name for language in known]
        self.letters = "".join(sorted({c for language in known for c in language.letters}))
        self._tables: dict[int, np.ndarray] = {}
        self._own: dict[int, np.ndarray] = {}

    def symbols(self) -> np.ndarray:
        """Symbol of every code point: 0 is a blank, 1 a letter that no language knows."""
        if not hasattr(self, "_symbols"):
            known = {letter: k + 2 for k, letter in enumerate(self.letters)}
            out = np.zeros(0x110000, np.int32)
            for code in range(0x110000):
                c = chr(code)
                if c.isalpha():
                    lower = c.lower()
                    out[code] = known.get(lower, 1)
            self._symbols = out
        return self._symbols

    def own_symbols(self, k: int) -> np.ndarray:
        """The symbol of a language for each symbol of the model."""
        if k not in self._own:
            place = {letter: n + 2 for n, letter in enumerate(self.known[k].letters)}
            self._own[k] = np.array([0, 1, *[place.get(letter, 1) for letter in self.letters]], np.int32)
        return self._own[k]

    def encode(self, text: str) -> np.ndarray:
        """The symbols of a text, with every run of blanks as one."""
        found = self.symbols()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
        keep = np.ones(len(found), bool)
        keep[1:] = (found[1:] != 0) | (found[:-1] != 0)
        return found[keep]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """(texts, languages) numbers of phrases."""
        total = np.zeros((len(texts), len(self.known)), np.int64)
        blocks, owners = [], []
        for k, symbols in enumerate(texts):
            for at in range(0, len(symbols), BLOCK):
                blocks.append(symbols[at : at + BLOCK])
                owners.append(k)
                if len(blocks) == LANES:
                    self._add(blocks, owners, total)
                    blocks, owners = [], []
        if blocks:
            self._add(blocks, owners, total)
        return total

    def _table(self, k: int) -> np.ndarray:
        if k in self._tables:
            return self._tables[k]
        table = self.known[k].table()
        if sum(kept.nbytes for kept in self._tables.values()) + table.nbytes <= TABLE_BYTES:
            self._tables[k] = table
        return table

    def _add(self, blocks: list[np.ndarray], owners: list[int], total: np.ndarray) -> None:
        sizes = np.array([len(block) for block in blocks])
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        columns = np.zeros((sizes[0], len(blocks)), np.int32)
        for lane, k in enumerate(order):
            columns[: len(blocks[k]), lane] = blocks[k]
        active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
        for number, language in enumerate(self.known):
            table, width, first = self._table(number), language.columns(), language.first()
            flat = table.ravel()
            own = self.own_symbols(number)[columns]
            rare = (own >= width).any(axis=1) if len(first) > width else np.zeros(len(own), bool)
            state = np.zeros(len(blocks), np.int32)
            ended = np.zeros(len(blocks), np.int32)
            for step in range(sizes[0]):
                n = active[step]
                symbol = own[step, :n]
                if rare[step]:
                    beyond = np.flatnonzero(symbol >= width)
                    following = flat[state[:n] * width + np.minimum(symbol, width - 1)]
                    following[beyond] = language.rare(state[beyond], symbol[beyond], first)
                else:
                    following = flat[state[:n] * width + symbol]
                over = following < 0
                ended[:n] += over
                state[:n] = np.where(over, -1 - following, following)
            # the phrase that the block ends in
            np.add.at(total[:, number], np.array(owners)[order], ended + 1)


def build(texts: dict[str, list[str]], characters: int = LANGUAGE_CHARACTERS) -> Model:
    """The model of some text per language, cut to ``characters`` each; ties go to the first."""
    return Model([learn(name, rows, characters) for name, rows in texts.items()])


def train(docs: DataFrame) -> Model:
    """The model of labelled documents (doc_id, text, lang); rows without text or lang teach nothing."""
    ship_package(docs.sparkSession)
    rows = take_columns(docs, doc_id="doc_id", text="text", lang="lang").where("text is not null and lang is not null")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    chosen = (
        rows.select("doc_id", "lang", F.substring("text", 1, ROW_CHARACTERS).alias("text"))
        .withColumn("k", F.row_number().over(order))
        .where(F.col("k") <= ROWS_PER_LANGUAGE)
    )
    characters = LANGUAGE_CHARACTERS

    def one(table: pa.Table) -> pa.Table:
        texts = [text for _, text in sorted(zip(table["k"].to_pylist(), table["text"].to_pylist()))]
        found = learn(table["lang"][0].as_py(), texts, characters)
        return pa.table({
            "lang": [found.name], "letters": [found.letters], "states": pa.array([found.states], pa.int64()),
            "keys": [found.keys.tobytes()], "targets": [found.targets.tobytes()],
        })

    schema = "lang string, letters string, states long, keys binary, targets binary"
    # one row of at most three moves a character for each language
    learnt = {row.lang: row for row in chosen.groupBy("lang").applyInArrow(one, schema).collect()}
    counted = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    found = [learnt[row.lang] for row in counted]
    return Model([
        Language(r.lang, r.letters, np.frombuffer(r.keys, np.int64), np.frombuffer(r.targets, np.int32), r.states)
        for r in found
    ])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of documents (doc_id, text)."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [model.encode(text or "") for text in batch.column(1).to_pylist()]
            lettered = np.array([bool(symbols.any()) for symbols in texts], bool)
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if len(model.languages):
                phrases = model.phrases(texts)
                best = phrases.argmin(axis=1)
                lowest = np.sort(phrases, axis=1)
                if len(model.languages) > 1:
                    scores = 1 - lowest[:, 0] / np.maximum(lowest[:, 1], 1)
                else:
                    scores = np.ones(len(texts))
                names = [model.languages[k] if full else UNKNOWN for k, full in zip(best, lettered)]
                scores = np.where(lettered, scores, 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    key = docs.schema["doc_id"].dataType.simpleString()
    rows = take_columns(docs, doc_id="doc_id", text="text")
    return rows.mapInArrow(parse, f"doc_id {key}, lang_pred string, score double")
