"""Language-model scoring by cross-entropy difference (Moore and Lewis, 2010).

Two bigram models are counted over all documents: the target model over documents labelled good, the background model over
every document. They are matched: one vocabulary, one order, one smoothing, and the background's counts are scaled to the
target's mass, so neither model is sharper for having seen more.
A document's score is the mean over its tokens of target loss minus background loss: lower is nearer the target. Its own counts
are taken off a model that has seen it, so labelled and other documents are scored alike.

Every distinct word and bigram has a row of its own, keyed by 64 bits, in a table that is spread over shards and grows with the
corpus. Documents are dealt into chunks; a chunk sends each of its distinct words and bigrams to a shard once, and gets the totals
of just those back. So nothing is broadcast or collected, and a word of every text reaches its shard once a chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold, word_hashes

#: Least number of words that smoothing leaves room for, weight of the bigram estimate, mass added to every word.
VOCABULARY, LAMBDA, ADDED = 1 << 18, 0.7, 0.5
#: Stands before the first word of a text.
START = 0
#: Bytes of text in a chunk, about, and chunks for each shard.
CHUNK, CHUNKS_PER_SHARD = 1 << 22, 4


def word_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of 63 bits of all words, never 0, which is START, and how many words each text has."""
    flat, sizes = word_hashes(texts, xxhash.xxh3_64_intdigest)
    return np.maximum(flat >> np.uint64(1), np.uint64(1)).astype(np.int64), sizes


def bigram_ids(ids: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """The key of each word and the one before it."""
    if before is None:
        before = np.concatenate([[START], ids[:-1]]) if len(ids) else ids
    mixed = before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + ids.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed.view(np.int64)


class Chunk:
    """The tokens of some texts as places in their sorted distinct words (START is the first) and bigrams."""

    def __init__(self, texts: pa.Table, good: set[int]):
        hold("lm_scoring")
        found, self.sizes = word_ids(texts.column("text"))
        self.target = np.array([d in good for d in texts.column("doc_id").to_pylist()], bool)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        ids = np.concatenate([np.zeros(1, np.int64), found])
        self.words, place = np.unique(ids, return_inverse=True)
        self.word = place[1:]
        first = np.cumsum(self.sizes)[self.sizes > 0] - self.sizes[self.sizes > 0]
        self.context, before = place[:-1].copy(), ids[:-1].copy()
        self.context[first], before[first] = 0, START
        self.pairs, self.pair = np.unique(bigram_ids(ids[1:], before), return_inverse=True)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """For each word: background and target counts as a word and as a context; for each bigram: background and target."""
        seen = self.target[self.doc]
        table = lambda n, *places: np.array([np.bincount(p[s], minlength=n) for p in places for s in (slice(None), seen)], np.int64)
        return table(len(self.words), self.word, self.context), table(len(self.pairs), self.pair)

    def own(self, place: np.ndarray, n: int) -> np.ndarray:
        """How often each token's word or bigram occurs in its own text."""
        _, at, count = np.unique(self.doc * n + place, return_inverse=True, return_counts=True)
        return count[at]


def _cuts(keys: np.ndarray, shards: int, low: int, high: int) -> np.ndarray:
    """Where each shard's range of keys begins and ends."""
    bounds = np.array([low + (high - low) * k // shards for k in range(1, shards)], np.int64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])


def _pack(values: np.ndarray) -> bytes:
    """Integers by planes of equal bytes, as most of their high bytes are zero: 4 bytes of length, then zstd."""
    planes = np.ascontiguousarray(np.ascontiguousarray(values, np.int64).reshape(-1).view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(planes).to_bytes(4, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(packed: bytes, rows: int) -> np.ndarray:
    planes = pa.decompress(packed[4:], int.from_bytes(packed[:4], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(np.int64).reshape(rows, -1)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, which wrap."""
    return _pack(np.diff(keys, prepend=np.int64(0)))


def _unpack_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(_unpack(packed, 1)[0])


SENT = "shard long, chunk long, words binary, word_counts binary, pairs binary, pair_counts binary"
TOTALS = "chunk long, shard long, word_counts binary, pair_counts binary, n_words long, background long, target long, doc_id long"
SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def _send(shards: int):
    """Texts of a chunk and the targets among them -> one row for every shard."""

    def run(texts: pa.Table, good: pa.Table) -> pa.Table:
        schema = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), *((c, pa.binary()) for c in ("words", "word_counts", "pairs", "pair_counts"))])
        if not texts.num_rows:
            return schema.empty_table()
        chunk = Chunk(texts, set(good.column("doc_id").to_pylist()))
        w, p = chunk.counts()
        at, to = _cuts(chunk.words, shards, 0, 1 << 63), _cuts(chunk.pairs, shards, -(1 << 63), 1 << 63)
        key = texts.column("chunk")[0].as_py()
        rows = [
            (k, key, _pack_keys(chunk.words[a:b]), _pack(w[:, a:b]), _pack_keys(chunk.pairs[c:d]), _pack(p[:, c:d]))
            for k, (a, b, c, d) in enumerate(zip(at, at[1:], to, to[1:]))
        ]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _totals(sent: pa.Table) -> pa.Table:
    """Rows of one shard -> for every chunk the totals of its keys, in its order, and those of the whole shard."""

    def summed(keys: str, counts: str, columns: int):
        own = [_unpack_keys(k) for k in sent.column(keys).to_pylist()]
        found, place = np.unique(np.concatenate(own), return_inverse=True)
        given = np.concatenate([_unpack(c, columns) for c in sent.column(counts).to_pylist()], axis=1)
        # sums in doubles are exact up to 2**53
        total = np.array([np.bincount(place, g, len(found)) for g in given]).astype(np.int64)
        ends = np.cumsum([len(k) for k in own])[:-1]
        return total, [_pack(total[:, p]) for p in np.split(place, ends)]

    total, per_word = summed("words", "word_counts", 4)
    _, per_pair = summed("pairs", "pair_counts", 2)
    n = sent.num_rows
    whole = (int((total[0] > 0).sum()), int(total[0].sum()), int(total[1].sum()))
    return pa.Table.from_arrays(
        [sent.column("chunk"), sent.column("shard"), pa.array(per_word, pa.binary()), pa.array(per_pair, pa.binary()), *(pa.array([x] * n, pa.int64()) for x in whole), pa.nulls(n, pa.int64())],
        names=["chunk", "shard", "word_counts", "pair_counts", "n_words", "background", "target", "doc_id"],
    )


def _judge(texts: pa.Table, right: pa.Table) -> pa.Table:
    """Texts of a chunk, its totals and the targets among them -> scores."""
    is_total = right.column("shard").is_valid()
    totals, good = right.filter(is_total).sort_by("shard"), right.filter(right.column("shard").is_null())
    chunk = Chunk(texts, set(good.column("doc_id").to_pylist()))
    n = chunk.sizes
    if not n.sum():
        losses = [np.zeros(len(n)), np.zeros(len(n))]
    else:
        by_word, by_pair = (np.concatenate([_unpack(x, k) for x in totals.column(c).to_pylist()], axis=1) for c, k in (("word_counts", 4), ("pair_counts", 2)))
        n_words, background, target = (sum(totals.column(c).to_pylist()) for c in ("n_words", "background", "target"))
        mass, room = float(target or background), max(VOCABULARY, n_words)
        own = [chunk.own(p, k) for p, k in ((chunk.pair, len(chunk.pairs)), (chunk.context, len(chunk.words)), (chunk.word, len(chunk.words)))]
        losses = []
        for part, size, seen in ((1, target, chunk.target), (0, background, np.ones(len(n), bool))):
            # if the model has seen the text, its own counts are taken off first, so it is not scored by itself
            off = seen[chunk.doc]
            joint, context, word = (c - o * off for c, o in zip((by_pair[part][chunk.pair], by_word[2 + part][chunk.context], by_word[part][chunk.word]), own))
            left = size - n * seen
            scale = np.divide(mass, left, out=np.zeros(len(n)), where=left > 0)[chunk.doc]
            estimate = np.divide(joint, context, out=np.zeros(len(joint)), where=context > 0)
            # the bigram estimate counts for as much as its context has been seen, at one scale for both models
            trust = LAMBDA * context * scale / (context * scale + 1)
            single = (word * scale + ADDED) / (mass + ADDED * room)
            bits = -np.log2(trust * estimate + (1 - trust) * single)
            losses.append(np.bincount(chunk.doc, bits, len(n)) / np.maximum(n, 1))
    column = lambda x: pa.array(x, pa.float64(), mask=n == 0)
    return pa.Table.from_arrays(
        [texts.column("doc_id"), pa.array(n), column(losses[0]), column(losses[1]), column(losses[0] - losses[1])], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"]
    )


def targets(labels: DataFrame) -> DataFrame:
    """Ids labelled quality 1 and not toxic, by every label the document has."""
    good = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    good = good.agg(F.min(F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False))).alias("is_target"))
    return good.where("is_target").select("doc_id")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_tokens, target_loss, background_loss, score; bits per token, means over the whole text.

    Each document is scored by models that leave it out. Null, empty and blank texts have no tokens, and null losses and score.
    If no document is a target the target model is uniform. Repeated rows count and are scored repeatedly; other columns are
    ignored. The number of chunks comes from the size of the texts, which is summed first.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    chunks = size // CHUNK + 1
    chunk = lambda key: F.pmod(key, F.lit(chunks)).cast("long").alias("chunk")
    # rows without an id are dealt by their texts
    texts = rows.select("doc_id", "text", chunk(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))))
    good = targets(labels).select("doc_id", chunk(F.xxhash64("doc_id")))
    sent = texts.groupBy("chunk").cogroup(good.groupBy("chunk")).applyInArrow(_send(chunks // CHUNKS_PER_SHARD + 1), SENT)
    totals = sent.groupBy("shard").applyInArrow(_totals, TOTALS).unionByName(good, allowMissingColumns=True)
    return texts.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(_judge, SCORES)


def _bits(part: str, seen: str) -> str:
    """A token's loss under one model, its own text's counts taken off if that model has seen it."""
    off = f"CASE WHEN {seen} THEN 1 ELSE 0 END"
    context, scale = f"(v.{part} - {off} * xv.n)", f"(CASE WHEN tot.{part} > {off} * s.n THEN tot.mass / (tot.{part} - {off} * s.n) ELSE 0 END)"
    trust = f"({LAMBDA}::DOUBLE * {context} * {scale} / ({context} * {scale} + 1))"
    estimate = f"(CASE WHEN {context} > 0 THEN (p.{part} - {off} * xp.n) / {context}::DOUBLE ELSE 0 END)"
    single = f"(((w.{part} - {off} * xw.n) * {scale} + {ADDED}::DOUBLE) / (tot.mass + {ADDED}::DOUBLE * tot.room))"
    return f"sum(xp.n * -log2({trust} * {estimate} + (1 - {trust}) * {single})) / any_value(s.n)"


#: score() of `documents` and `labels` as DuckDB SQL, losses rounded to 6 places.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS l FROM documents),
gd AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING bool_and(coalesce(quality = 1 AND coalesce(toxic, 0) = 0, false))),
sz AS (SELECT r, doc_id, len(l) AS n, doc_id IN (SELECT doc_id FROM gd) AS good FROM d),
tk AS (SELECT r, l[i] AS w, CASE WHEN i = 1 THEN '' ELSE l[i - 1] END AS v FROM (SELECT r, l, unnest(range(1, len(l) + 1)) AS i FROM d)),
ow AS MATERIALIZED (SELECT r, w, count(*) AS n FROM tk GROUP BY ALL), ov AS MATERIALIZED (SELECT r, v, count(*) AS n FROM tk GROUP BY ALL), op AS MATERIALIZED (SELECT r, v, w, count(*) AS n FROM tk GROUP BY ALL),
cw AS (SELECT w, sum(o.n) AS b, coalesce(sum(o.n) FILTER (good), 0) AS t FROM ow o JOIN sz USING (r) GROUP BY ALL), cv AS (SELECT v, sum(o.n) AS b, coalesce(sum(o.n) FILTER (good), 0) AS t FROM ov o JOIN sz USING (r) GROUP BY ALL),
cp AS (SELECT v, w, sum(o.n) AS b, coalesce(sum(o.n) FILTER (good), 0) AS t FROM op o JOIN sz USING (r) GROUP BY ALL),
tot AS (SELECT b, t, CASE WHEN t > 0 THEN t ELSE b END::DOUBLE AS mass, greatest({VOCABULARY}, (SELECT count(*) FROM cw)) AS room FROM (SELECT sum(n) AS b, coalesce(sum(n) FILTER (good), 0) AS t FROM sz)),
ls AS (SELECT xp.r, {_bits("t", "s.good")} AS target_loss, {_bits("b", "true")} AS background_loss FROM op xp JOIN sz s USING (r) JOIN ow xw ON xw.r = xp.r AND xw.w = xp.w JOIN ov xv ON xv.r = xp.r AND xv.v = xp.v
JOIN cw w ON w.w = xp.w JOIN cv v ON v.v = xp.v JOIN cp p ON p.v = xp.v AND p.w = xp.w, tot GROUP BY xp.r)
SELECT doc_id, n AS n_tokens, round(target_loss, 6) + 0.0 AS target_loss, round(background_loss, 6) + 0.0 AS background_loss, round(target_loss - background_loss, 6) + 0.0 AS score FROM sz LEFT JOIN ls USING (r)
"""
