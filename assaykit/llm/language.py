"""Language of a text by cross-parsing: the language whose sample parses it into the fewest phrases, normalised, wins.

A text is parsed from left to right into longest pieces that occur in a language's sample (a byte that
never occurs there is a phrase of its own). With c phrases over n bytes and a sample of N bytes,
c log2(N) / n estimates the cross entropy. Longest matches come from a suffix automaton of the sample.
Its transitions are completed, once for each worker, by the step that a broken match takes: end the
phrase, begin the next at the root with the same byte. So each byte is one look-up in a table, and many
texts and all languages take a step at once.

Texts are parsed as bytes of their UTF-8 form: A-Z in lower case, other ASCII characters than letters as
spaces, runs of these as one. They are parsed whole, in stretches of STRETCH bytes, at whose ends a
phrase ends for every language.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaykit.llm.common import bound_batches, compact, remainder, table, text_slices

#: Bytes of a language's sample at most; of them from one document at most; rows that it is chosen from, about.
SAMPLE, SHARE, ROWS = 32_768, 4096, 512
#: Bytes parsed at a stretch; what a language without a name is called.
STRETCH, UNKNOWN = 2048, "und"

_BYTES = bytes((b | 32) if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def plain_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of texts as they are parsed, one text after the other, and the n + 1 places where texts begin and end."""
    texts = compact(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = texts.buffers()[2]
    raw = np.frombuffer(data.to_pybytes().translate(_BYTES) if data else b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    space = raw == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    starts = ends[:-1][np.diff(ends) > 0]
    keep[starts] = True
    return raw[keep], np.concatenate([[0], np.cumsum(keep)])[ends]


def automaton(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transitions (from, byte, to) of the suffix automaton of a text; state 0 is its root."""
    links, lengths, steps = [-1], [0], [{}]
    last = 0
    for byte in text:
        now = len(steps)
        lengths.append(lengths[last] + 1)
        links.append(0)
        steps.append({})
        at = last
        while at >= 0 and byte not in steps[at]:
            steps[at][byte] = now
            at = links[at]
        if at >= 0:
            to = steps[at][byte]
            if lengths[at] + 1 == lengths[to]:
                links[now] = to
            else:
                twin = len(steps)
                lengths.append(lengths[at] + 1)
                links.append(links[to])
                steps.append(dict(steps[to]))
                while at >= 0 and steps[at].get(byte) == to:
                    steps[at][byte] = twin
                    at = links[at]
                links[to] = links[now] = twin
        last = now
    size = [len(s) for s in steps]
    begin = np.repeat(np.arange(len(steps), dtype=np.int32), size)
    return begin, np.array([b for s in steps for b in s], np.uint8), np.array([t for s in steps for t in s.values()], np.int32)


class Model:
    """Languages in rising order, the bytes of their samples, and the transitions of their automata."""

    def __init__(self, names: list[str], sizes: list[int], automata: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.names, self.sizes, self.automata = names, np.array(sizes, float), automata

    def __getstate__(self):  # tables are made where they are used
        return {k: self.__dict__[k] for k in ("names", "sizes", "automata")}

    @functools.cached_property
    def _tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, roots, steps). symbols[byte, l]: a byte's column in language l, 0 for strangers.

        steps[state + symbol] is 4 * next state + phrases that end with the step; a state is the place
        where its row begins, so the rows of all languages are one array.
        """
        symbols, roots, parts, base = np.zeros((256, len(self.names)), np.int64), [], [], 0
        for k, (begin, byte, to) in enumerate(self.automata):
            known = np.unique(byte)
            symbols[known, k] = 1 + np.arange(len(known))
            width, states = len(known) + 1, 1 + int(max(begin.max(initial=0), to.max(initial=0)))
            step = np.zeros((states, width), np.int64)
            column = symbols[byte, k]
            first = begin == 0
            step[:, 0] = 4 * base + 2  # the phrase ends, and the stranger is one
            step[:, column[first]] = 4 * (base + width * to[first].astype(np.int64)) + 1
            step[0, 0] = 4 * base + 1
            step[begin, column] = 4 * (base + width * to.astype(np.int64))
            roots.append(base)
            parts.append(step.ravel())
            base += step.size
        steps = np.concatenate(parts)
        return symbols, np.array(roots, np.int64), steps.astype(np.int32) if 4 * base + 4 < 1 << 31 else steps

    def phrases(self, raw: np.ndarray, ends: np.ndarray, stretch: int = STRETCH) -> np.ndarray:
        """Phrases of each text in each language."""
        symbols, roots, steps = self._tables
        size = np.diff(ends)
        many = -(-size // stretch)
        owner = np.repeat(np.arange(len(size)), many)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        begin = ends[:-1][owner] + stretch * within
        length = np.minimum(stretch, ends[1:][owner] - begin)
        order = np.argsort(-length, kind="stable")  # those that still have bytes come first
        owner, begin, length = owner[order], begin[order], length[order]
        active = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), side="left")
        state = np.tile(roots, (len(owner), 1))
        count = np.zeros(state.shape, np.int32)
        for t, a in enumerate(active.tolist()):
            got = steps.take(symbols[raw[begin[:a] + t]] + state[:a])
            count[:a] += got & 3
            state[:a] = got >> 2
        count += state != roots
        return np.column_stack([np.bincount(owner, c, len(size)) for c in count.T]).astype(np.int64)

    def costs(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Normalised phrases of each text in each language: bits a byte."""
        return self.phrases(raw, ends) * np.log2(self.sizes + 1) / np.maximum(np.diff(ends), 1)[:, None]


def learn(docs: DataFrame, learning, sample: int = SAMPLE, share: int = SHARE, rows: int = ROWS) -> Model:
    """A model of the values of lang, from rows for which the condition `learning` holds.

    A language's sample is chosen by a hash of the texts, so of equal texts one counts: the first
    `rows` of them, about, as far as they fill `sample` bytes, at most `share` characters of each.
    Rows whose text has no letter, or whose lang is null, teach nothing. No such rows: no languages.
    """
    bound_batches(docs.sparkSession)
    text, whole = F.col("text").cast("string"), float(1 << 63)
    own = docs.where(learning & F.col("lang").isNotNull() & text.isNotNull()).select(F.col("lang").cast("string").alias("lang"), text.alias("text"))
    found = own.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each language
    if not found:
        return Model([], [], [])
    edges = docs.sparkSession.createDataFrame([(r.lang, min(whole, -whole + 2 * whole * 2 * rows / r.n)) for r in found], "lang string, edge double")
    chosen = own.withColumn("h", F.xxhash64("text")).join(F.broadcast(edges), "lang").where((F.col("h") <= F.col("edge")) & F.col("text").rlike(r"\p{L}"))
    chosen = chosen.groupBy("lang", "h").agg(F.min(F.left("text", F.lit(share))).alias("text"))
    own = Window.partitionBy("lang").orderBy("h")
    chosen = chosen.withColumn("r", F.row_number().over(own)).where(F.col("r") <= rows).withColumn("before", F.sum(F.octet_length("text")).over(own) - F.octet_length("text")).where(F.col("before") < sample)

    def run(key, got):
        raw, ends = plain_bytes(got.sort_by("h").column("text").combine_chunks())
        text = b"\0".join(raw[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False))[:sample]  # 0 is in no text
        begin, byte, to = automaton(text)
        return pa.table({"lang": [key[0].as_py()], "size": [len(text)], "begin": [begin.tobytes()], "byte": [byte.tobytes()], "to": [to.tobytes()]})

    made = chosen.select("lang", "h", "text").groupBy("lang").applyInArrow(run, "lang string, size long, begin binary, byte binary, to binary").toArrow().to_pylist()
    made.sort(key=lambda r: r["lang"])
    automata = [(np.frombuffer(r["begin"], np.int32), np.frombuffer(r["byte"], np.uint8), np.frombuffer(r["to"], np.int32)) for r in made]
    return Model([r["lang"] for r in made], [r["size"] for r in made], automata)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of each row's whole text.

    The language of the smallest cost, of ties the first by name; score: the second cost over the sum of
    the first two (0.5: a tie; 1: one language alone). A null text, one without a letter, and any
    text for a model without languages: `und` with 0. Repeated rows are predicted each; other columns are
    left out. No rows give no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch in batches:
            for lo, hi in text_slices(batch, 1):
                part = batch.slice(lo, hi - lo)
                texts = compact(part.column(1))
                names, score = np.full(len(part), UNKNOWN, object), np.zeros(len(part))
                some = np.flatnonzero(pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)) if m.names else np.zeros(0, np.int64)
                if len(some):
                    cost = m.costs(*plain_bytes(texts.take(pa.array(some))))
                    best = cost.argmin(1)
                    names[some] = np.array(m.names, object)[best]
                    two = np.sort(cost, axis=1)[:, :2]
                    score[some] = two[:, 1] / two.sum(1) if len(m.names) > 1 else 1.0
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def op11_cross_parse(spark, sf_dir: str) -> DataFrame:
    """Every row of documents; learned from rows whose crc32(doc_id) modulo 4 isn't 2. Nulls, texts without letters, repeats: see predict and learn."""
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 4) == 2
    got = predict(docs, learn(docs, ~held_out))
    return got.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
