"""Language identification by cross-parsing entropy.

For each language a sample of its labelled text is kept as a suffix automaton. A text is parsed against it greedily
into the longest pieces that occur somewhere in the sample; the fewer pieces, the better the sample predicts the
text. Pieces x log2(sample length) / text length is the (Ziv-Merhav) cross entropy in bits per letter, and the
language with the least wins.

Every letter of the samples is a symbol of its own; only letters that no sample holds are one more symbol, without an
edge in any automaton. Successors by the commonest ``LETTERS`` symbols are rows of a table, all others sorted pairs of
state and symbol, so scripts with thousands of letters cost what their sample costs.

Automata are looked up in arrays, so whole batches of texts are parsed at once: long texts are laid side by side in strips of ``STRIP`` letters, and one step moves every strip of every text by one
letter. A strip ends a piece, so a text of n letters gains at most n / STRIP pieces over an unbroken parse, the same
for every language.

The sample is the only bounded thing: ``SAMPLE`` letters in all, shared evenly by the languages, taken from the
labelled texts in the order of a hash of the id, from each its first ``PER_DOCUMENT`` letters. It is gathered per
language with partial aggregation that never keeps more than the sample. A language with less text than its share
gives what it has and takes nothing from the others: the length of a sample is in the bits a piece costs.

Defined results: a text that is null, empty or without a letter gets ``und`` and score 0; where nothing was learned
every text gets that; ties go to the language first by code point; repeated rows are judged alike; null labels are
not learned from; columns besides doc_id, text and lang are carried along by ``identify`` and clashing ones replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from haulscope.llm.common import by_bytes, free_name, give_back, held_out, table, texts

SAMPLE = 120_000  # letters of labelled text in all automata together
PER_DOCUMENT = 600  # letters that one labelled text gives at most
STRIP = 1024
LETTERS = 63  # commonest letters of the sample, which have columns in the table; the others are sorted pairs
UNDETERMINED = "und"
ADDED = ("lang_pred", "score", "bits", "n_letters")
JUDGED = "lang_pred string, score double, bits double, n_letters long"
_FIELDS = [pa.field(n, t) for n, t in zip(ADDED, (pa.string(), pa.float64(), pa.float64(), pa.int64()))]
SLICE = 1 << 20  # bytes of text that are parsed at once
SURE = 12.0  # how fast the score rises with the lead over the second language, in texts' relative entropy


def normalised(text: str) -> str:
    """Lower case; white space and everything that is not a letter become single spaces."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


class Codes:
    """Symbols of a text: 0 for a space, then the letters of the sample, last any other letter."""

    def __init__(self, letters: str):
        self.letters = letters
        self.other = len(letters) + 1
        self.table = np.zeros(0x110000, np.min_scalar_type(self.other))
        space = np.zeros(0x110000, bool)
        for c in range(0x110000):
            space[c] = not chr(c).isalpha()
        self.table[~space] = self.other
        for k, c in enumerate(letters):
            self.table[ord(c)] = k + 1

    def encode(self, text: str) -> np.ndarray:
        """Symbols of the lower-cased text with runs of spaces joined and none at the ends."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.table[points]
        word = symbols > 0
        keep = word.copy()
        keep[1:] |= word[:-1]  # the space that follows a word
        symbols = symbols[keep]
        return symbols[:-1] if len(symbols) and not symbols[-1] else symbols


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Suffix automaton: for each state its successors by symbol; 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for s in symbols:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and s not in step[p]:
            step[p][s] = new
            p = link[p]
        if p >= 0:
            q = step[p][s]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(s) == q:
                    step[p][s] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


class Model:
    """Automata of all languages in one table and one list of pairs; a text is parsed against all of them at once.

    An entry is what a letter does in a state: the row of the next state, and in the lowest two bits how many
    pieces end there. Where the automaton has no successor the piece ends before the letter, which starts the
    next one; a letter that the sample lacks is a piece of its own.
    """

    def __init__(self, letters: str, samples: dict[str, list[int]]):
        self.codes = Codes(letters)
        self.common = min(len(letters), LETTERS)
        self.width = self.common + 2  # the last column is for letters without an edge
        self.langs = sorted(samples)
        tables, starts, rare, at = [], [], [], 0
        for lang in self.langs:
            step = automaton(samples[lang])
            t = np.zeros((len(step), self.width), np.int64)
            for state, after_ in enumerate(step):
                for s, to in after_.items():
                    if s <= self.common:
                        t[state, s] = to
                    else:
                        rare.append(((state + at) * (self.codes.other + 1) + s, (to + at) * self.width << 2))
            first, known = t[0][None, :], t > 0
            ends = np.where(known, 0, 1 + (first == 0))
            ends[0] = first[0] == 0  # nothing was open at the start
            after = np.where(known, t, first)
            tables.append(((after + at) * self.width << 2) | ends)
            starts.append(at * self.width)
            at += len(t)
        self.steps = np.concatenate(tables).reshape(-1).astype(np.int32 if at * self.width < 1 << 28 else np.int64) if tables else np.zeros(0, np.int32)
        pairs = np.array(sorted(rare), np.int64).reshape(-1, 2)
        self.rare_keys, self.rare_steps = np.ascontiguousarray(pairs[:, 0]), pairs[:, 1].astype(self.steps.dtype)
        self.starts = np.array(starts, self.steps.dtype)
        self.bits = np.array([np.log2(max(2, len(samples[lang]))) for lang in self.langs])

    def _rare(self, state: np.ndarray, symbols: np.ndarray, start: int) -> np.ndarray:
        """Entries for symbols that have no column."""

        def look(states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            keys = states.astype(np.int64) // self.width * (self.codes.other + 1) + symbols
            at = np.minimum(np.searchsorted(self.rare_keys, keys), max(0, len(self.rare_keys) - 1))
            if not len(self.rare_keys):
                return np.zeros(len(keys), bool), np.zeros(len(keys), self.steps.dtype)
            return self.rare_keys[at] == keys, self.rare_steps[at]

        known, entry = look(state)
        opens, fresh = look(np.full(len(state), start))
        lost = self.steps.take(state + self.width - 1)  # no edge from here or from the start
        return np.where(known, entry, np.where(opens, fresh | 1, lost))

    def pieces(self, texts_: list[np.ndarray]) -> np.ndarray:
        """Number of pieces of each text (row) under each language (column)."""
        nl = len(self.langs)
        out = np.zeros((len(texts_), nl), np.int64)
        lengths = np.array([len(t) for t in texts_])
        if not lengths.sum():
            return out
        strips = -(-lengths // STRIP)
        owner = np.repeat(np.arange(len(texts_)), strips)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(strips) - strips, strips)
        size = np.minimum(STRIP, lengths[owner] - number * STRIP)
        begin = np.repeat(np.cumsum(lengths) - lengths, strips) + number * STRIP
        order = np.argsort(-size, kind="stable")  # strips that end drop off at the end
        owner, size, begin = owner[order], size[order], begin[order]
        symbols = np.concatenate(texts_).astype(np.int64)
        flat = np.minimum(symbols, self.width - 1).astype(self.steps.dtype)
        odd = (symbols > self.common) & (symbols < self.codes.other)
        some_odd = bool(odd.any())
        live = np.searchsorted(-size, -np.arange(1, STRIP + 1), side="right")  # strips at least as long as each step
        for lang, start in enumerate(self.starts):
            state = np.full(len(owner), start)
            found = np.zeros(len(owner), state.dtype)
            for k in range(int(size[0])):
                now, count, at = state[: live[k]], found[: live[k]], begin[: live[k]] + k
                if some_odd and len(apart := np.flatnonzero(odd[at])):
                    rare = self._rare(now[apart], symbols[at[apart]], start)
                else:
                    apart = None
                now += flat[at]
                entry = self.steps.take(now)
                if apart is not None:
                    entry[apart] = rare
                np.right_shift(entry, 2, out=now)
                entry &= 3
                count += entry
            found += state != start  # the piece that the strip's end cuts
            np.add.at(out[:, lang], owner, found)
        return out

    def entropies(self, texts_: list[np.ndarray]) -> np.ndarray:
        lengths = np.array([max(1, len(t)) for t in texts_])
        return self.pieces(texts_) * self.bits / lengths[:, None]


@lru_cache(maxsize=2)
def _model(key: tuple[str, tuple[tuple[str, bytes], ...]]) -> Model:
    """One per Python worker, from the letters and the samples."""
    letters, samples = key
    return Model(letters, {lang: np.frombuffer(s, "<u4").tolist() for lang, s in samples})


def _judged(columns: Iterator[pa.Array], shared) -> Iterator[pa.Array]:
    """Texts to what each is taken for; a slice of texts is parsed at once, so memory follows its bytes."""
    model = _model(shared.value)
    for column in columns:
        parts = [_parsed(model, part) for part in by_bytes(pa.RecordBatch.from_arrays([column], ["text"]), "text", SLICE)]
        yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct(_FIELDS))
    give_back()


def _parsed(model: Model, batch: pa.RecordBatch) -> pa.Array:
    coded = [model.codes.encode(t) for t in texts(batch.column("text"))]
    some = [i for i, c in enumerate(coded) if len(c)]
    lang = [UNDETERMINED] * batch.num_rows
    score, bits = np.zeros(batch.num_rows), np.full(batch.num_rows, np.nan)
    letters = [int(np.count_nonzero(c)) for c in coded]
    if model.langs and some:
        e = model.entropies([coded[i] for i in some])
        best = e.argmin(axis=1)
        least = e[np.arange(len(some)), best]
        lead = np.exp(-SURE * (e - least[:, None]) / np.maximum(least[:, None], 1e-9))
        for i, b, p, h in zip(some, best, 1 / lead.sum(axis=1), least):
            lang[i], score[i], bits[i] = model.langs[b], p, h
    columns = [pa.array(lang), pa.array(score), pa.array(bits, from_pandas=True), pa.array(letters, pa.int64())]
    return pa.StructArray.from_arrays(columns, fields=_FIELDS)


def learn(labelled: DataFrame, sample: int = SAMPLE, per_document: int = PER_DOCUMENT) -> tuple[str, tuple[tuple[str, bytes], ...]]:
    """Letters and samples from ``labelled`` (doc_id, text, lang); what reaches the driver is bounded by ``sample``."""
    known = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    langs = known.select("lang").distinct().count()
    if not langs:
        return "", ()
    share = max(1, sample // langs)
    # what marks, spaces and capitals take away is allowed for
    usable = known.select("doc_id", "lang", F.substring("text", 1, 4 * min(per_document, share) + 100).alias("text"))
    # so many documents of a language are enough at a third of the letters each; smallest hashes first
    enough = max(1, -(-3 * share // per_document))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    rows = usable.withColumn("n", F.row_number().over(order)).where(F.col("n") <= enough).orderBy("lang", "n").collect()
    chosen: dict[str, str] = {}
    for r in rows:
        text = chosen.get(r.lang, "")
        if len(text) < share:
            chosen[r.lang] = f"{text} {normalised(r.text)[:per_document]}".strip()[:share]
    counts: dict[str, int] = {}
    for text in chosen.values():
        for c in text.replace(" ", ""):
            counts[c] = counts.get(c, 0) + 1
    letters = "".join(sorted(counts, key=lambda c: (-counts[c], c)))
    codes = Codes(letters)
    return letters, tuple(sorted((lang, codes.encode(text).astype("<u4").tobytes()) for lang, text in chosen.items()))


def judgement(spark: SparkSession, model: tuple[str, tuple[tuple[str, bytes], ...]], text: Column) -> Column:
    """(lang_pred, score, bits, n_letters) of each text; only the text goes to Python, and only these come back."""
    shared = spark.sparkContext.broadcast(model)  # at most the sample

    @F.arrow_udf(JUDGED)
    def judged(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _judged(columns, shared)

    # so that a filter on the result does not parse the texts a second time
    return judged.asNondeterministic()(text)


def identify(docs: DataFrame, model: tuple[str, tuple[tuple[str, bytes], ...]], column: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score, bits (cross entropy per letter; null where undetermined) and n_letters."""
    docs = docs.drop(*ADDED)
    judged = free_name(docs, "judged")
    rows = docs.withColumn(judged, judgement(docs.sparkSession, model, F.col(column)))
    return rows.select(*docs.columns, *(F.col(judged)[c].alias(c) for c in ADDED))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).select(
        "doc_id", "held_out", "lang_pred", "score", "bits"
    )
