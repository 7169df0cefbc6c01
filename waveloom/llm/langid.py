"""Language identification by cross-parsing entropy (Ziv and Merhav, 1993).

For every language a suffix automaton is built over a bounded sample of labelled text. A text is parsed
greedily into the longest phrases that occur in the sample; phrases times log2 of the sample's length, over
the text's length, estimate the cross entropy. The language with the fewest normalised phrases wins.

Greedy parsing restarts at the root after a failed transition, so each automaton becomes a table
(state, letter class) -> (state, restarted); a batch of texts runs through all tables in lock step. Long texts are cut into lanes
for that. A lane starts from the state that a run over the characters before it leads to, which is the parse's own state wherever
two parses have come together; where the state at the end of the lane before turns out to be another one, the lane is run again
from that, so the result is that of one parse of the whole text.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hold, slices

#: Characters of labelled text learned per language, pieces they come from, and characters of a piece.
SAMPLE_CHARS, SAMPLE_PIECES, PIECE_CHARS = 32_768, 64, 1_024
#: Languages that are learned, those with the most labelled texts first; bytes of tables, beyond which transitions are searched for.
LANGUAGES, TABLE_BYTES = 128, 1 << 26
#: Characters of a lane, and of the run before it.
LANE, BEFORE = 4_096, 256
#: Texts, and bytes of text, that run through the tables at a time.
BATCH, BATCH_BYTES = 1_500, 1 << 22


def remainder(doc_id="doc_id"):
    """crc32 of doc_id as text, mod 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3


def sample(docs: DataFrame) -> dict[str, str]:
    """At most SAMPLE_CHARS characters for each label, from texts in an order fixed by a hash of doc_id."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder() != 1)).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return {}
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30))
    bar = F.coalesce(F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1 << 30, (1 << 30) * 4 * SAMPLE_PIECES // n)))])[F.col("lang")], F.lit(0))
    some = rows.where(draw <= bar).select("lang", draw.alias("draw"), "doc_id", F.substring("text", 1, PIECE_CHARS).alias("text"))
    order = Window.partitionBy("lang").orderBy("draw", "doc_id", "text")
    some = some.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= SAMPLE_PIECES)
    pieces: dict[str, list[str]] = {}
    for r in some.orderBy("lang", "rn").collect():
        pieces.setdefault(r["lang"], []).append(r["text"])
    return {k: "\n".join(v)[:SAMPLE_CHARS] for k, v in sorted(pieces.items()) if any(any(c.isalpha() for c in t) for t in v)}


@lru_cache(1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: its lower case form (0 for what is no letter), and whether it is a letter."""
    points = np.arange(0x110000)
    is_letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    lower = np.where(is_letter, points, 32).astype(np.uint32)
    for i in np.flatnonzero(is_letter):
        if len(c := chr(i).lower()) == 1:
            lower[i] = ord(c)
    return lower, is_letter


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return step


class Model:
    """The parsers of all languages: letter classes, and transitions by (state, class), as one table or as sorted keys.

    A value is twice the next state, plus one if a phrase starts with the character. Missing transitions lead to the state that the
    root has for the character, and start a phrase; a letter that the sample lacks is a phrase, and leads back to the root.
    """

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        lower, self.is_letter = letters()
        folded = [lower[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)] for _, t in samples]
        known = np.unique(np.concatenate(folded))
        self.width = len(known) + 1
        self.classes = np.full(0x110000, len(known), np.uint8 if self.width < 256 else np.uint16 if self.width < 65_536 else np.int32)
        self.classes[known] = np.arange(len(known))
        self.classes = self.classes[lower]
        self.bits = np.log2([max(2, len(c)) for c in folded])
        roots, keys, values, base = [], [], [], 0
        # what follows a missing transition: the root's own, by language and class
        self.start = np.zeros((len(samples), self.width), np.int32)
        for k, codes in enumerate(folded):
            step = automaton(np.searchsorted(known, codes).tolist())
            self.start[k] = 2 * base + 1
            for c, q in step[0].items():
                self.start[k, c] = 2 * (base + q) + 1
            own = [(s * self.width + c, 2 * (base + q)) for s, out in enumerate(step[1:], base + 1) for c, q in sorted(out.items())]
            keys.append(np.fromiter((x for x, _ in own), np.int64, len(own)))
            values.append(np.fromiter((x for _, x in own), np.int32, len(own)))
            roots.append(base)
            base += len(step)
        self.roots = np.array(roots, np.int32)
        self.keys, self.values = np.concatenate(keys), np.concatenate(values)
        self.table = None
        if 4 * base * self.width <= TABLE_BYTES:
            self.table = np.empty((base, self.width), np.int32)
            for k, (a, b) in enumerate(zip(roots, [*roots[1:], base])):
                self.table[a:b] = self.start[k]
            self.table = self.table.ravel()
            self.table[self.keys] = self.values
            self.keys = self.values = np.zeros(0, np.int32)

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Values for states (languages x lanes) and classes (lanes)."""
        at = state.astype(np.int64) * self.width + c
        if self.table is not None:
            return self.table[at]
        place = np.minimum(np.searchsorted(self.keys, at), len(self.keys) - 1)
        return np.where(self.keys[place] == at, self.values[place], self.start[:, c])

    def walk(self, k: int, state: int, codes: np.ndarray) -> tuple[int, int]:
        """One language over one lane: the state at its end and the phrases that start in it."""
        count, width, start = 0, self.width, self.start[k].tolist()
        if self.table is not None:
            table = memoryview(self.table)
            for c in codes.tolist():
                v = table[state * width + c]
                state = v >> 1
                count += v & 1
            return state, count
        keys, values = memoryview(self.keys), memoryview(self.values)
        for c in codes.tolist():
            at = state * width + c
            place = bisect_left(keys, at)
            v = values[place] if place < len(keys) and keys[place] == at else start[c]
            state = v >> 1
            count += v & 1
        return state, count


@lru_cache(1)
def model(samples: tuple[tuple[str, str], ...]) -> Model:
    return Model(samples)


def phrases(texts: list[str], trained: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: phrases per language (texts x languages), characters, and whether it has a letter."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    letter_at = np.flatnonzero(trained.is_letter[points])
    has_letter = np.searchsorted(letter_at, ends) > np.searchsorted(letter_at, starts)
    codes = trained.classes[points]
    lanes = -(-lengths // LANE)
    owner = np.repeat(np.arange(len(texts)), lanes)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    at = starts[owner] + nth * LANE
    size = np.minimum(LANE, lengths[owner] - nth * LANE)
    entry = np.repeat(trained.roots[:, None], len(at), 1)
    later = np.flatnonzero(nth)
    if len(later):
        state = entry[:, later]
        for t in range(-BEFORE, 0):
            state = trained.step(state, codes[at[later] + t]) >> 1
        entry[:, later] = state
    order = np.argsort(-size, kind="stable")
    active = np.searchsorted(-size[order], -np.arange(size.max() if len(size) else 0), "left")  # lanes longer than t
    state, count, sorted_at = entry[:, order], np.zeros((len(trained.roots), len(at)), np.int64), at[order]
    for t, k in enumerate(active.tolist()):
        v = trained.step(state[:, :k], codes[sorted_at[:k] + t])
        state[:, :k] = v >> 1
        count[:, :k] += v & 1
    leave, total = np.empty_like(state), np.empty_like(count)
    leave[:, order], total[:, order] = state, count
    # lanes whose parse comes from another state than the one they were run from, one after another
    for k in range(len(trained.roots)):
        wrong = later[leave[k, later - 1] != entry[k, later]].tolist()
        while wrong:
            lane = wrong.pop(0)
            while True:
                entry[k, lane] = leave[k, lane - 1]
                before = leave[k, lane]
                leave[k, lane], total[k, lane] = trained.walk(k, int(entry[k, lane]), codes[at[lane] : at[lane] + size[lane]])
                if leave[k, lane] == before or lane + 1 == len(owner) or not nth[lane + 1]:
                    break
                lane += 1
                if wrong and wrong[0] == lane:
                    wrong.pop(0)
    return np.array([np.bincount(owner, t, len(texts)) for t in total]).T.reshape(len(texts), len(trained.roots)), lengths, has_letter


def predict(texts: list[str | None], samples: tuple[tuple[str, str], ...]) -> tuple[list[str], np.ndarray]:
    if not samples or not texts:
        return ["und"] * len(texts), np.zeros(len(texts))
    trained = model(samples)
    total, lengths, has_letter = phrases([t or "" for t in texts], trained)
    bits = total * trained.bits / np.maximum(lengths, 1)[:, None]
    best = bits.argmin(1)
    low = bits[np.arange(len(texts)), best]
    others = bits.copy()
    others[np.arange(len(texts)), best] = np.inf
    score = np.where(has_letter, 1 - low / np.maximum(others.min(1), 1e-12), 0.0)
    names = [k for k, _ in samples]
    return [names[b] if ok else "und" for b, ok in zip(best.tolist(), has_letter.tolist())], np.clip(score, 0, 1)


def identify(docs: DataFrame, train: DataFrame | None = None, text_column: str = "text") -> DataFrame:
    """docs with lang_pred and score added (columns of these names are replaced).

    train: labelled rows (doc_id, text, lang), docs by default; only those whose crc32(doc_id) mod 3 is not 1 are
    learned from, at most SAMPLE_CHARS characters of each language. A null text, or one without any letter, gets
    `und` and score 0, and so does every text if nothing is labelled. score is 1 - best / second best bits per
    character: 0 for a tie, which goes to the language that sorts first; 1 if only one language is known.
    Texts are read whole, and parsed as one whatever their length. Repeated rows get equal results.
    """
    samples = tuple(sample(docs if train is None else train).items())
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(*kept).withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0)}).schema

    place = kept.index(text_column)

    def run(batches):
        hold("langid", model.cache_clear)
        for batch in slices(batches, place, BATCH, BATCH_BYTES):
            names, score = predict(batch.column(place).to_pylist(), samples)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "score"]
            )

    return docs.select(*kept).mapInArrow(run, schema)


def identified(docs: DataFrame) -> DataFrame:
    """The query's form: only doc_id and text go to the classifier. One row per row, repeated ones too; null, empty and blank texts are
    `und`; an empty table gives none; other columns are ignored."""
    out = identify(docs.select("doc_id", "text"), docs.select("doc_id", "text", "lang"))
    return out.select("doc_id", (remainder() == 1).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame) -> DataFrame:
    """The documents with a language, their columns as they are: those that identify() calls `und` go (null, empty and letterless texts, and
    all if nothing is labelled). Repeated rows stay repeated; an empty table stays empty."""
    return identify(docs).where(F.col("lang_pred") != "und").select(*docs.columns)
