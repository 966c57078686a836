"""Pieces of a SentencePiece vocabulary as a unigram model: counts over a trie, N-best segmentations.

The vocabulary file is read as it is. A piece's log probability follows its rank r (from 0) among
the ordinary pieces: p = 1 / (H (r + 2)). One space is put in front of a text, and it is cut into
pre-tokens before each space or, with runs, before the first space of each run: a piece may be a run
of spaces, so only the latter is best over the whole text. Spaces are written as U+2581. A character that is no piece is spelt in
UTF-8 byte pieces, each FALL below the rarest piece; so is a U+2581 that stands in the text itself.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from dataclasses import dataclass
from itertools import count
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import bound_batches, compact, table, text_slices
from assaykit.llm.stats import sums

SPACE, OWN = "▁", "\ud800"  # a space; a U+2581 of the text (no text has lone surrogates)
FALL, SLICE_BYTES, KNOWN = 10.0, 8 << 20, 250_000
RUN = re.compile(" +[^ ]*")


@dataclass
class Pieces:
    """score and id by piece, and both together; ids of the 256 bytes; the score of a byte; the longest piece's length."""

    score: dict[str, float]
    ids: dict[str, int]
    bytes_: list[int]
    fall: float
    longest: int
    table: dict[str, tuple[float, tuple[int, ...]]]
    #: Every ending of a piece, with the score of those that are pieces: where none fits, no longer piece does.
    endings: dict[str, float | None]
    #: A piece's id in little-endian bytes.
    packed: dict[str, bytes]

    @classmethod
    def read(cls, path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [k for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k))]
        names = {int(sp.id_to_piece(k)[1:-1], 16): k for k in range(sp.get_piece_size()) if sp.is_byte(k)}
        total = math.log(math.fsum(1 / (r + 2) for r in range(len(plain))))
        score = {sp.id_to_piece(k): -math.log(r + 2) - total for r, k in enumerate(plain)}
        ids = {sp.id_to_piece(k): k for k in plain}
        return cls(score, ids, [names[b] for b in range(256)], min(score.values()) - FALL, max(map(len, score)), {x: (s, (ids[x],)) for x, s in score.items()}, {x[k:]: None for x in score for k in range(len(x))} | score, {x: array("I", [k]).tobytes() for x, k in ids.items()})

    def spelt(self, char: str) -> list[int]:
        """Ids of a character that is no piece."""
        return [self.bytes_[b] for b in (SPACE if char == OWN else char).encode()]


def trie_counts(tokens: list[str], pieces: Pieces) -> list[tuple[int, float]]:
    """(pieces, score) of the best segmentation of each pre-token.

    tokens: sorted and distinct, which is a trie's depth-first order. Forward scores of a path are
    kept on a stack, so a prefix that many tokens share is scored once; a token's end tells its own
    count. Of equal scores the fewer pieces count.
    """
    get = pieces.endings.get
    best, n, last, out = [0.0], [0], "", []
    for token in tokens:
        shared, most = 0, min(len(last), len(token))
        while shared < most and last[shared] == token[shared]:
            shared += 1
        del best[shared + 1 :], n[shared + 1 :]
        for end in range(shared + 1, len(token) + 1):
            top, steps = -math.inf, 0
            for begin in range(end - 1, -1, -1):
                s = get(token[begin:end], 1.0)  # scores are negative
                if s is None:
                    continue
                if s > 0:
                    break
                s += best[begin]
                if s > top or (s == top and n[begin] + 1 < steps):
                    top, steps = s, n[begin] + 1
            char = token[end - 1]
            if char not in pieces.score:
                k = 3 if char == OWN else len(char.encode())
                s = best[end - 1] + pieces.fall * k
                if s > top or (s == top and n[end - 1] + k < steps):
                    top, steps = s, n[end - 1] + k
            best.append(top)
            n.append(steps)
        out.append((n[-1], best[-1]))
        last = token
    return out


def lattices(tokens, pieces: Pieces):
    """For each token, in sorted order: it, forward Viterbi scores of its ends, and their arcs so far found (see _arcs).

    The lists are stacks: ends of a prefix that a token shares with the last one stay as they are,
    and they are good until the next token only.
    """
    get, table = pieces.endings.get, pieces.table
    best, arcs, last = [0.0], [[]], ""
    for token in tokens:
        shared, most = 0, min(len(last), len(token))
        while shared < most and last[shared] == token[shared]:
            shared += 1
        del arcs[shared + 1 :], best[shared + 1 :]
        for end in range(shared + 1, len(token) + 1):
            top = -math.inf
            for begin in range(end - 1, -1, -1):
                s = get(token[begin:end], 1.0)  # scores are negative
                if s is None:
                    continue
                if s > 0:
                    break
                s += best[begin]
                if s > top:
                    top = s
            if token[end - 1] not in table:
                top = max(top, best[end - 1] + pieces.fall * len(pieces.spelt(token[end - 1])))
            best.append(top)
            arcs.append(None)
        last = token
        yield token, best, arcs


def _arcs(token: str, end: int, best: list[float], pieces: Pieces) -> list[tuple[float, int, float, tuple[int, ...]]]:
    """What may stand last before an end: (worth of the best path over it, begin, score, ids), best first."""
    get, table, own = pieces.endings.get, pieces.table, []
    for begin in range(end - 1, -1, -1):
        s = get(token[begin:end], 1.0)
        if s is None:
            continue
        if s > 0:
            break
        own.append((best[begin] + s, begin, *table[token[begin:end]]))
    if token[end - 1] not in table:
        ids = tuple(pieces.spelt(token[end - 1]))
        own.append((best[end - 1] + pieces.fall * len(ids), end - 1, pieces.fall * len(ids), ids))
    own.sort(key=_by_worth, reverse=True)
    return own


def n_best(token: str, pieces: Pieces, n: int, best=None, arcs=None) -> list[tuple[float, tuple[int, ...]]]:
    """The n best segmentations (score, ids) of a pre-token, best first; of equal scores as the search meets them.

    Forward Viterbi scores are the exact remaining worth of a search that goes back from the end. So
    a path taken from the heap loses nothing by going on over the best arcs to the beginning; at
    each place it passes, the next best arc is put on the heap with what the whole path would be worth.
    """
    if best is None:
        _, best, arcs = next(lattices([token], pieces))
    out: list[tuple[float, tuple[int, ...]]] = []
    heap, order = [(0.0, 0, len(token), 0, 0.0, None)], 0  # ids so far: (first, the others' pair)
    while heap and len(out) < n:
        _, _, at, which, worth, ids = heapq.heappop(heap)
        while at:
            own = arcs[at]
            if own is None:
                own = arcs[at] = _arcs(token, at, best, pieces)
            if which + 1 < len(own) and len(out) + 1 < n:  # the last path needs no successors
                order += 1
                heapq.heappush(heap, (-(worth + own[which + 1][0]), order, at, which + 1, worth, ids))
            _, at, s, new = own[which]
            worth, ids, which = worth + s, (new, ids), 0
        whole = []
        while ids:
            new, ids = ids
            whole += new
        out.append((worth, tuple(whole)))
    return out


_by_worth = itemgetter(0)


def best_paths(tokens, pieces: Pieces):
    """For each token, in sorted order: (score, loss, ids_le) of its best segmentation and what the next best loses.

    The next best path leaves the best one, seen from the end, at one of its places, by the second
    best arc there: the least difference of both arcs' worths along the path is its loss, which a
    search for two paths would find.
    """
    get, table, spelt = pieces.endings.get, pieces.table, pieces.spelt
    best, second, back, last = [0.0], [0.0], [0], ""
    packed = pieces.packed
    for token in tokens:
        shared, most = 0, min(len(last), len(token))
        while shared < most and last[shared] == token[shared]:
            shared += 1
        del best[shared + 1 :], second[shared + 1 :], back[shared + 1 :]
        for end in range(shared + 1, len(token) + 1):
            top = next_ = -math.inf
            at = end - 1
            for begin in range(end - 1, -1, -1):
                s = get(token[begin:end], 1.0)  # scores are negative
                if s is None:
                    continue
                if s > 0:
                    break
                s += best[begin]
                if s > top:
                    top, next_, at = s, top, begin
                elif s > next_:
                    next_ = s
            if token[end - 1] not in table:
                s = best[end - 1] + pieces.fall * len(spelt(token[end - 1]))
                if s > top:
                    top, next_, at = s, top, end - 1
                elif s > next_:
                    next_ = s
            best.append(top)
            second.append(next_)
            back.append(at)
        last, end, loss, ids = token, len(token), math.inf, []
        while end:
            loss = min(loss, best[end] - second[end])
            x = token[back[end] : end]
            ids.append(packed[x] if x in packed else array("I", spelt(x)).tobytes())
            end = back[end]
        ids.reverse()
        yield best[-1], loss, b"".join(ids)


def pre_tokens(texts: pa.Array, runs: bool = False) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Codes of texts' pre-tokens, where texts end among them, and the distinct ones; empty texts have none.

    runs: a run of spaces stays whole, with the word after it.
    """
    texts = compact(texts)
    runs = runs and len(texts) > 0 and (pc.any(pc.match_substring(texts, "  ")).as_py() or pc.any(pc.starts_with(texts, " ")).as_py())
    if runs or (len(texts) and pc.any(pc.match_substring(texts, SPACE)).as_py()):
        strings = [x.replace(SPACE, OWN) for x in texts.to_pylist()]
        if runs:
            lists = [[y[1:].replace(" ", SPACE) for y in RUN.findall(" " + x)] if x else [] for x in strings]
        else:
            lists = [x.split(" ") if x else [] for x in strings]
        ends = np.cumsum([0, *map(len, lists)])
        codes: dict[str, int] = {}
        flat = [codes.setdefault(x, len(codes)) for own in lists for x in own]
        return np.array(flat, np.int64), ends, [SPACE + x for x in codes]
    lists = pc.split_pattern(texts, " ")
    coded = lists.values.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    if empty.any():  # an empty text splits into one empty token
        keep = np.ones(len(codes), bool)
        keep[ends[:-1][empty & (np.diff(ends) > 0)]] = False
        ends = np.concatenate([[0], np.cumsum(keep)])[ends]
        codes = codes[keep]
    return codes, ends, [SPACE + x for x in coded.dictionary.to_pylist()]


def _broadcast(docs: DataFrame, path: str, runs: bool):
    bound_batches(docs.sparkSession)
    pieces = Pieces.read(path)
    if runs and any(SPACE in x.lstrip(SPACE) for x in pieces.score):
        raise ValueError("a piece has a space after another character: texts can't be cut before spaces")
    return docs.sparkSession.sparkContext.broadcast(pieces)


def token_counts(docs: DataFrame, path: str, runs: bool = False) -> DataFrame:
    """doc_id, n_pretokens, n_tokens and score (log probability) of each row's best segmentation.

    A null or empty text has none and score 0. Repeated rows are counted each. Other columns are
    left out. No rows give no rows. runs: see pre_tokens.
    """
    shared = _broadcast(docs, path, runs)

    def run(batches):
        pieces = shared.value
        for batch in batches:
            for lo, hi in text_slices(batch, 1, SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                codes, ends, distinct = pre_tokens(part.column(1), runs)
                order = sorted(range(len(distinct)), key=distinct.__getitem__)
                found = np.zeros((len(distinct), 2))
                if order:
                    found[order] = trie_counts([distinct[k] for k in order], pieces)
                own = np.repeat(np.arange(len(part)), np.diff(ends))
                score = np.bincount(own, found[codes, 1], len(part)) if len(codes) else np.zeros(len(part))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(ends)), pa.array(sums(found[codes, 0].astype(np.int64), ends)), pa.array(score)], names=["doc_id", "n_pretokens", "n_tokens", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_pretokens long, n_tokens long, score double")


def best_choices(losses: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n choices of one entry from each list (rising from 0) with the least sums: (sum, indexes)."""
    start = (0,) * len(losses)
    heap, seen, out = [(0.0, 0, start)], {start}, []
    order = count(1)
    while heap and len(out) < n:
        loss, _, choice = heapq.heappop(heap)
        out.append((loss, choice))
        for k, own in enumerate(losses):
            if choice[k] + 1 < len(own):
                new = (*choice[:k], choice[k] + 1, *choice[k + 1 :])
                if new not in seen:
                    seen.add(new)
                    heapq.heappush(heap, (sum(x[i] for x, i in zip(losses, new, strict=True)), next(order), new))
    return out


def spelling(pieces: Pieces) -> dict[int, bytes]:
    """The UTF-8 bytes that each id stands for, a space for each U+2581."""
    return {k: x.replace(SPACE, " ").encode() for x, k in pieces.ids.items()} | {k: bytes([b]) for b, k in enumerate(pieces.bytes_)}


def spell(ids_le: bytes, spelt: dict[int, bytes], front: int = 1) -> bytes:
    """The text of some ids, without the space in front of it."""
    return b"".join(map(spelt.__getitem__, np.frombuffer(ids_le, "<u4").tolist()))[front:]


def segmentations(docs: DataFrame, path: str, n: int = 3, runs: bool = False) -> DataFrame:
    """doc_id, row, rank, score, ids_le, round_trip: each row's n best segmentations over its whole text.

    round_trip: whether the ids, decoded again, spell the text. The best one is decoded whole; the others
    spell the same if each place where they differ does, which are decoded.

    A text's best is every pre-token's best. Its n best take others than the best in at most n - 1
    places, those with the least to lose there (of equal ones the first), which n_best searches. ids_le: little-endian
    unsigned 32-bit ids. row tells repeated rows apart, within a task. A null or empty text has one
    segmentation, without pieces, of score 0. Other columns are left out. No rows give no rows.
    runs: see pre_tokens.
    """
    shared = _broadcast(docs, path, runs)

    def run(batches):
        pieces, known, old, full, row = shared.value, {}, {}, {}, 0  # tokens of late stay known
        spelt = spelling(pieces)

        def alternatives(token: str) -> list[tuple[float, bytes, bool]]:
            """The n best of a pre-token, and whether they spell what the best one does."""
            if token not in full:
                if len(full) > KNOWN // 10:
                    full.clear()
                found = [(s, array("I", ids).tobytes()) for s, ids in n_best(token, pieces, n)]
                text = spell(found[0][1], spelt, 0)
                full[token] = [(s, ids, spell(ids, spelt, 0) == text) for s, ids in found]
            return full[token]

        for batch in batches:
            for lo, hi in text_slices(batch, 1, 2 << 20):
                part = batch.slice(lo, hi - lo)
                codes, ends, distinct = pre_tokens(part.column(1), runs)
                if len(known) > KNOWN:
                    known, old = {}, known
                new = []
                for x in distinct:
                    if x not in known:
                        if x in old:
                            known[x] = old[x]
                        else:
                            new.append(x)
                new.sort()
                known.update(zip(new, best_paths(new, pieces), strict=True))
                best, loss, first = zip(*map(known.__getitem__, distinct), strict=True) if distinct else ((), (), ())
                best, loss = np.array(best), np.array(loss)
                size = np.fromiter(map(len, first), np.int64, len(first))
                doc, rows, ranks, scores, ids, same = [], [], [], [], [], []
                for k, text in enumerate(part.column(1).to_pylist()):
                    own = codes[ends[k] : ends[k + 1]]
                    total, whole = float(best[own].sum()) if len(own) else 0.0, b"".join(map(first.__getitem__, own.tolist()))
                    losses, places = loss[own] if len(own) else np.zeros(0), np.arange(len(own))
                    if len(own) > n - 1 > 0:  # more places than can differ from the best
                        edge = np.partition(losses, n - 2)[n - 2]
                        places = np.concatenate([np.flatnonzero(losses < edge), np.flatnonzero(losses == edge)])[: n - 1]
                    places = [int(p) for p in np.sort(places) if n > 1 and losses[p] < np.inf]
                    lists = [alternatives(distinct[own[p]]) for p in places]
                    until = np.cumsum(size[own]) if places else None
                    spells = spell(whole, spelt) == (text or "").encode()
                    for rank, (less, choice) in enumerate(best_choices([[x[0][0] - s for s, _, _ in x] for x in lists], n), 1):
                        made, at, fits = [], 0, spells
                        for p, x, c in zip(places, lists, choice, strict=True):
                            if c:  # this place's pieces are others than in the best
                                end = int(until[p])
                                made += (whole[at : end - int(size[own[p]])], x[c][1])
                                at, fits = end, fits and x[c][2]
                        made.append(whole[at:])
                        doc.append(k)
                        rows.append(row)
                        ranks.append(rank)
                        scores.append(total - less)
                        ids.append(b"".join(made))
                        same.append(fits)
                    row += 1
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc, pa.int64())), pa.array(rows), pa.array(ranks, pa.int32()), pa.array(scores), pa.array(ids, pa.binary()), pa.array(same, pa.bool_())], names=["doc_id", "row", "rank", "score", "ids_le", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row long, rank int, score double, ids_le binary, round_trip boolean")


def decoded(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with the column text that ids_le spell, in place of ids_le; null ids give a null text."""
    spark = encoded.sparkSession
    bound_batches(spark)
    pieces = Pieces.read(path)
    shared = spark.sparkContext.broadcast(spelling(pieces))
    others = [f for f in encoded.schema.fields if f.name != "ids_le"]

    def run(batches):
        spelt = shared.value
        for batch in batches:
            at = batch.schema.get_field_index("ids_le")
            for lo, hi in text_slices(batch, at):
                part = batch.slice(lo, hi - lo)
                texts = [None if x is None else spell(x, spelt).decode() for x in part.column(at).to_pylist()]
                keep = [k for k in range(part.num_columns) if k != at]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(texts, pa.string())], names=[*(part.schema.names[k] for k in keep), "text"])

    from pyspark.sql import types as T

    return encoded.mapInArrow(run, T.StructType([*others, T.StructField("text", T.StringType())]))


def public_pieces() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op7_trie_counts(spark, sf_dir: str) -> DataFrame:
    """Every row of documents; nulls, empty texts and repeats: see token_counts."""
    return token_counts(table(spark, sf_dir, "documents"), public_pieces(), runs=True)


def op8_nbest(spark, sf_dir: str) -> DataFrame:
    """Every row of documents; nulls, empty texts and repeats: see segmentations."""
    found = segmentations(table(spark, sf_dir, "documents"), public_pieces(), runs=True)
    return found.select("doc_id", "rank", "score", (F.octet_length("ids_le") / 4).cast("long").alias("n_pieces"), F.crc32("ids_le").alias("ids_crc32"), "round_trip")
