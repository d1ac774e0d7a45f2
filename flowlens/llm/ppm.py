"""LM scoring by prediction by partial matching: a byte-context trie, escapes, symbol exclusion.

A text is its tokens: words of bytes, each closed by a blank, then one end symbol. The next byte is predicted from up to
``ORDER`` bytes before it: the longest context seen in training gives its probability; a context that has not seen the byte
gives an escape (method C: distinct bytes over occurrences plus distinct bytes) and hands over to the next shorter one, where
the bytes of the longer context are excluded.

With ``across`` a context is any bytes of the text, those of the words before and their blanks included, and only the text's
start ends it. Every task sums up the events (context and byte in one long) of its texts' whole streams before they are dealt;
step 3 below gives their scores, and each text adds up those of its own stream.

Otherwise contexts end at a token's start, so equal tokens have equal code lengths and the trie's counts are sums over distinct words:

1. words of all documents are counted (all words; training counts);
2. every distinct word adds its byte events (context and byte in one long) to the trie's counts;
3. events are dealt by their last two context bytes, so all their longer contexts meet in one place; orders 0 and 1 (65,536
   counts at most) go to every task;
4. each word's events are summed up to its log-probability, and each document's words to its own.

Step 4, and the streams, look up a table that grows with the corpus. Its most frequent entries, up to a fixed number, go to every task; all
others are joined. So nothing unbounded is broadcast, and hot keys are settled where they are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import CHUNK_BYTES, pieces, row_numbers, text_rows, texts_of
from flowlens.session import cut

ORDER = 5
CLOSE, END = b" ", b"\n"
#: Bytes that can follow: all but the four kinds of white space that are neither CLOSE nor END.
SYMBOLS = 252
#: Entries of a table that go to every task, and the longest word among them.
HEAD_WORDS, HEAD_EVENTS, HEAD_BYTES = 1 << 19, 1 << 18, 64
#: The same for events of whole streams.
HEAD_STREAM = 1 << 20
#: Bytes of a stream looked at together, and distinct events that a task holds before it hands them on.
STRETCH, EVENTS_AT_ONCE = 1 << 18, 2_000_000
#: Events of the longest part that are added up with those of the others at once.
RANGE = 1 << 14
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Distinct words that a task counts before it hands them on.
COUNTED_AT_ONCE = 300_000
#: Rows of a batch that a task hands on.
ROWS = 1 << 16


class Lookup:
    """Places of keys in an array: one slot for each hash, that of its last key; the others by bisection."""

    def __init__(self, keys: np.ndarray):
        self.n = len(keys)
        self.keys = np.append(keys, np.uint64((1 << 64) - 1))
        bits = max(1, (2 * self.n).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slot = np.full(1 << bits, self.n, np.int32)
        self.slot[self._hash(keys)] = np.arange(self.n, dtype=np.int32)
        rest = np.flatnonzero(self.keys[self.slot[self._hash(keys)]] != keys)
        self.more_at = rest[np.argsort(keys[rest])]
        self.more = keys[self.more_at]

    def _hash(self, keys):
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, the array's length where it is unknown."""
        at = self.slot[self._hash(keys)]
        other = np.flatnonzero(self.keys[at] != keys)
        at[other] = self.n
        if len(self.more):
            more = np.minimum(np.searchsorted(self.more, keys[other]), len(self.more) - 1)
            there = self.more[more] == keys[other]
            at[other[there]] = self.more_at[more[there]]
        return at


@dataclass
class EventHead:
    """The most frequent events and their logp. A worker builds the lookup once, for all its tasks."""

    events: np.ndarray
    logp: np.ndarray

    @cached_property
    def lookup(self) -> Lookup:
        return Lookup(self.events)

    def of(self, events: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score of each event, 0 where unknown; places of the unknown ones)"""
        at = self.lookup.places(events)
        unknown = np.flatnonzero(at == len(self.logp))
        at[unknown] = 0
        score = self.logp[at] if len(self.logp) else np.zeros(len(events))
        score[unknown] = 0
        return score, unknown


def hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x) for x in words.to_pylist()), np.uint64, len(words))


@dataclass
class WordHead:
    """The most frequent words, their counts and logp, as arrays: as Python objects they would take a worker some 200 MB."""

    words: pa.Array
    c: np.ndarray
    logp: np.ndarray

    @cached_property
    def lookup(self) -> Lookup:
        return Lookup(np.concatenate([np.empty(0, np.uint64)] + [hashes(self.words.slice(a, ROWS)) for a in range(0, len(self.words), ROWS)]))

    def places(self, words: pa.Array) -> np.ndarray:
        """Place of each word, -1 where it is unknown. Of words with one hash some count as unknown, which are joined."""
        at = self.lookup.places(hashes(words))
        found = np.flatnonzero(at < len(self.words))
        same = pc.equal(self.words.take(pa.array(at[found])), words.take(pa.array(found))).to_numpy(zero_copy_only=False)
        places = np.full(len(words), -1, np.int64)
        places[found[same]] = at[found[same]]
        return places


@dataclass
class Model:
    """words: (word, c, logp); totals of training tokens and their kinds; the most frequent words. With contexts across words
    the words' logp is 0, and events are (event, c, logp) and the most frequent (event, logp), those last."""

    words: DataFrame
    train_tokens: int
    kinds: int
    head: WordHead
    events: DataFrame | None = None
    event_head: EventHead | None = None

    def base_denominator(self) -> float:
        return self.train_tokens + 0.5 * (self.kinds + 1)


def tokens_of(text: bytes) -> list[bytes]:
    return [*text.translate(LOWER).split(), END]


def events_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(event of every byte of every token, token it belongs to); an event is the context's bytes and the byte, last lowest."""
    closed = [w if w == END else w + CLOSE for w in words]
    sizes = np.fromiter(map(len, closed), np.int64, len(closed))
    flat = np.frombuffer(b"".join(closed), np.uint8).astype(np.uint64)
    inside = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    events = flat.copy()
    for k in range(1, ORDER + 1):
        far = np.flatnonzero(inside >= k)
        events[far] |= flat[far - k] << np.uint64(8 * k)
    return events, np.repeat(np.arange(len(words)), sizes)


def stretches(streams: list[bytes], most: int = STRETCH) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first stream, where it and the next ones begin, event of every byte) of stretches of streams, none of them empty."""
    sizes = np.fromiter(map(len, streams), np.int64, len(streams))
    starts = np.cumsum(sizes) - sizes
    flat = np.frombuffer(b"".join(streams), np.uint8)
    for a in range(0, len(flat), most):
        b, before = min(a + most, len(flat)), max(0, a - ORDER)
        part = flat[before:b].astype(np.uint64)
        events = part.copy()
        for k in range(1, ORDER + 1):
            events[k:] |= part[:-k] << np.uint64(8 * k)
        events = events[a - before :]
        for k in range(ORDER):
            at = starts[sizes > k] + k
            events[at[(at >= a) & (at < b)] - a] &= np.uint64((1 << 8 * (k + 1)) - 1)
        yield int(np.searchsorted(starts, a, "right")) - 1, np.append(0, starts[(starts > a) & (starts < b)] - a), events


def _count_words(rows: DataFrame) -> DataFrame:
    """(word, c): every token of all texts with its count in training texts."""

    def counted(held):
        table = pa.table({"word": pa.array(list(held), pa.binary()), "c": pa.array(list(held.values()), pa.int64())})
        return table.to_batches(max_chunksize=ROWS)

    def count(batches):
        held: Counter = Counter()
        for batch in batches:
            for part in pieces(batch):
                for text, use in zip(texts_of(part), part.column("train").to_pylist(), strict=True):
                    tokens = tokens_of(text)
                    held.update(tokens if use else dict.fromkeys(tokens, 0))
                if len(held) > COUNTED_AT_ONCE:
                    yield from counted(held)
                    held = Counter()
        yield from counted(held)

    return rows.mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _event_counts(words: DataFrame) -> DataFrame:
    """(event, c): summed over distinct words; c is 0 for events of unseen words only."""

    def count(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            events, of = events_of(batch.column("word").to_pylist())
            kinds, at = np.unique(events, return_inverse=True)
            c = np.bincount(at, batch.column("c").to_numpy()[of]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int64)), pa.array(c)], ["event", "c"])

    return words.mapInArrow(count, "event long, c long").groupBy("event").agg(F.sum("c").alias("c"))


def add_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct events of parts (events in order, counts), which are emptied, in order with their sums.

    Ranges of events are taken one by one, so that no order of all of them is held beside them.
    """
    longest = max((e for e, _ in parts), key=len)
    bounds = [0, *longest[RANGE::RANGE], None]
    cuts = [[0, *np.searchsorted(e, np.array(bounds[1:-1], np.uint64)), len(e)] for e, _ in parts]
    done = []
    for k in range(len(bounds) - 1):
        events = np.concatenate([e[at[k] : at[k + 1]] for (e, _), at in zip(parts, cuts, strict=True)])
        c = np.concatenate([c[at[k] : at[k + 1]] for (_, c), at in zip(parts, cuts, strict=True)])
        order = np.argsort(events, kind="stable")
        events = events[order]
        first = np.flatnonzero(np.append(True, events[1:] != events[:-1]))
        done.append((events[first], np.add.reduceat(c[order], first)))
    parts.clear()
    return np.concatenate([e for e, _ in done]), np.concatenate([c for _, c in done])


def _stream_counts(rows: DataFrame) -> DataFrame:
    """(event, c): every event of all texts' streams with its count in training texts, summed up in the task first."""

    def counted(held):
        """Batches of the events held, which are let go meanwhile."""
        table = pa.table([pa.array(x.view(np.int64)) for x in held.pop()], ["event", "c"])
        return table.to_batches(max_chunksize=ROWS)

    def count(batches):
        held, size = [], 0
        for batch in batches:
            for part in pieces(batch):
                texts, train = texts_of(part), part.column("train").to_pylist()
                for use in (True, False):
                    streams = [CLOSE.join(tokens_of(x)) for x, t in zip(texts, train, strict=True) if t == use]
                    for _, _, events in stretches(streams):
                        events.sort()
                        first = np.flatnonzero(np.append(True, events[1:] != events[:-1]))
                        held.append((events[first], np.diff(np.append(first, len(events))) * use))
                        size += len(first)
                        if size > EVENTS_AT_ONCE:
                            held = [add_up(held)]
                            size = len(held[0][0])
                            if size > EVENTS_AT_ONCE // 2:
                                yield from counted(held)
                                size = 0
        if held:
            held = [add_up(held)]
            yield from counted(held)

    return rows.mapInArrow(count, "event long, c long").groupBy("event").agg(F.sum("c").alias("c"))


def event_scores(events: np.ndarray, c: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 probability of each event's byte after its context.

    ``events`` hold all events that share two context bytes with any of them; ``pairs[b, s]`` counts byte s after byte b
    over the whole corpus.
    """
    score = np.zeros(len(events))
    open_ = np.ones(len(events), bool)
    left_out = np.zeros(len(events))  # occurrences, in the context looked at, of bytes that the longer one has seen
    left_out_kinds = np.zeros(len(events))

    def settle(n, total, kinds):
        rest, new = total - left_out, kinds - left_out_kinds
        tells = open_ & (rest + new > 0)
        seen = tells & (n > 0)
        escapes = tells & ~seen
        score[seen] += np.log10(n[seen] / (rest + new)[seen])
        score[escapes] += np.log10(new[escapes] / (rest + new)[escapes])
        open_[seen] = False

    last, first = (events >> np.uint64(8) & np.uint64(255)).astype(np.int64), (events & np.uint64(255)).astype(np.int64)
    for order in range(ORDER, 1, -1):
        key, at = np.unique(events & np.uint64((1 << 8 * (order + 1)) - 1), return_inverse=True)
        n = np.bincount(at, c, len(key))
        _, context = np.unique(key >> np.uint64(8), return_inverse=True)
        total, kinds = np.bincount(context, n), np.bincount(context, n > 0)
        settle(n[at], total[context][at], kinds[context][at])
        shorter = key & np.uint64((1 << 8 * order) - 1)
        if order > 2:
            parent, up = np.unique(events & np.uint64((1 << 8 * order) - 1), return_inverse=True)
            of_parent = np.bincount(up, c, len(parent))[np.searchsorted(parent, shorter)]
        else:
            of_parent = pairs[(shorter >> np.uint64(8)).astype(np.int64), (shorter & np.uint64(255)).astype(np.int64)]
        left_out = np.bincount(context, of_parent * (n > 0))[context][at]
        left_out_kinds = kinds[context][at].astype(float)
    kinds = (pairs > 0).sum(axis=1)
    settle(pairs[last, first], pairs.sum(axis=1)[last], kinds[last])
    bytes_ = pairs.sum(axis=0)
    left_out, left_out_kinds = ((pairs > 0) @ bytes_)[last], kinds[last].astype(float)
    settle(bytes_[first], np.full(len(events), bytes_.sum()), np.full(len(events), (bytes_ > 0).sum()))
    score[open_] -= np.log10(max(1, SYMBOLS - int((bytes_ > 0).sum())))
    return score


def _scored_events(events: DataFrame) -> DataFrame:
    """(event, c, logp)"""
    pairs = np.zeros((256, 256), np.int64)
    for r in events.groupBy(F.expr("event & 65535").alias("pair")).agg(F.sum("c").alias("c")).collect():
        pairs[r["pair"] >> 8, r["pair"] & 255] = r["c"]
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def score(batches):
        held = [x for x in batches if x.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            event, c = table.column("event").to_numpy(), table.column("c").to_numpy()
            logp = event_scores(event.view(np.uint64), c, pairs)
            yield from pa.table([pa.array(event), pa.array(c), pa.array(logp)], ["event", "c", "logp"]).to_batches(max_chunksize=ROWS)

    return events.repartition(n, F.expr("shiftright(event, 8) & 65535")).mapInArrow(score, "event long, c long, logp double")


def _head(table: DataFrame, most: int) -> DataFrame:
    """The most frequent rows, at most ``most``: all at or above a count that a histogram of counts' magnitudes gives."""
    step = F.floor(8 * F.log2(F.col("c") + 1)).alias("step")
    steps = sorted(((r["step"], r["n"]) for r in table.groupBy(step).agg(F.count("*").alias("n")).collect()), reverse=True)
    taken, least = 0, None
    for at, n in steps:
        taken += n
        if taken > most:
            break
        least = at
    return table.where(F.lit(False) if least is None else step >= least)


def _word_scores(words: DataFrame, events: DataFrame) -> DataFrame:
    """(word, c, logp): the sum over each word's events."""
    head = _head(events, HEAD_EVENTS).select("event", "logp").toArrow()
    known, logp = head.column("event").to_numpy(), head.column("logp").to_numpy()
    order = np.argsort(known)
    known, logp = known[order], logp[order]

    def score(batches):
        number = row_numbers()
        for batch in batches:
            if not batch.num_rows:
                continue
            found, of = events_of(batch.column("word").to_pylist())
            found = found.astype(np.int64)
            at = np.minimum(np.searchsorted(known, found), max(0, len(known) - 1))
            there = known[at] == found if len(known) else np.zeros(len(found), bool)
            sums = np.bincount(of[there], logp[at[there]], batch.num_rows).astype(float)
            missing = np.flatnonzero(~there)
            bounds = np.searchsorted(of[missing], np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([next(number) for _ in range(batch.num_rows)], pa.int64()), batch.column("word"), batch.column("c"),
                 pa.array(sums), pa.ListArray.from_arrays(pa.array(bounds), pa.array(found[missing]))],
                ["row", "word", "c", "logp", "rest"])

    scored = cut(words.mapInArrow(score, "row long, word binary, c long, logp double, rest array<long>"))
    rest = scored.select("row", F.explode("rest").alias("event")).join(events.select("event", F.col("logp").alias("more")), "event") \
        .groupBy("row").agg(F.sum("more").alias("more"))
    return scored.join(rest, "row", "left").select("word", "c", (F.col("logp") + F.coalesce("more", F.lit(0.0))).alias("logp"))


def in_training(doc_id) -> F.Column:
    """A row without an id is a training row."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0)) % 5 != 1


def train(rows: DataFrame, across: bool = False) -> Model:
    """Model of (text, train) rows: learned from those with ``train``, with the words (``across``: events) of all scored."""
    words = cut(_count_words(rows))
    events = cut(_scored_events(cut(_stream_counts(rows)) if across else _event_counts(words)))
    scored = words.withColumn("logp", F.lit(0.0)) if across else cut(_word_scores(words, events))
    totals = scored.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    head = _head(scored, HEAD_WORDS).where(F.length("word") <= HEAD_BYTES).toArrow()
    word, c, logp = (head.column(x).combine_chunks() for x in ("word", "c", "logp"))
    model = Model(scored, totals["n"], totals["v"], WordHead(word, c.to_numpy(), logp.to_numpy()))
    if across:
        head = _head(events, HEAD_STREAM).toArrow()
        event, c, logp = (head.column(x).to_numpy() for x in ("event", "c", "logp"))
        order = np.argsort(c)
        model.events, model.event_head = events, EventHead(event[order].astype(np.uint64), logp[order])
    return model


def score(rows: DataFrame, model: Model) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, base_score, score) of (doc_id, text, train) rows whose words (events) the model has."""
    below = model.base_denominator()
    spark = rows.sparkSession
    head, event_head = spark.sparkContext.broadcast(model.head), spark.sparkContext.broadcast(model.event_head)

    def of_words(tokens, known):
        """(known, base score, score) summed up over each text's tokens, and its (word, times) that are not in the head."""
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        starts = np.cumsum(sizes) - sizes
        coded = pa.array(list(chain.from_iterable(tokens)), pa.binary()).dictionary_encode()
        number, distinct = coded.indices.to_numpy(), coded.dictionary
        place = known.places(distinct)
        of_word = np.zeros((3, len(distinct)))
        there = np.flatnonzero(place >= 0)
        c = known.c[place[there]]
        of_word[:, there] = c > 0, np.log10((c + 0.5) / below), known.logp[place[there]]
        sums = [np.add.reduceat(x[number], starts) for x in of_word]
        far = np.flatnonzero(place[number] < 0)
        kinds, times = np.unique((np.searchsorted(starts, far, "right") - 1) * len(distinct) + number[far], return_counts=True)
        bounds = np.searchsorted(kinds, np.arange(len(tokens) + 1) * len(distinct))
        rest = pa.StructArray.from_arrays([distinct.take(pa.array(kinds % len(distinct))), pa.array(times.astype(np.int32))], ["word", "times"])
        return *sums, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rest)

    def of_streams(tokens, known):
        """Score of each text's stream, and its events that are not in the head."""
        own, texts, far = np.zeros(len(tokens)), [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for first, starts, events in stretches([CLOSE.join(t) for t in tokens]) if known else ():
            score, unknown = known.of(events)
            own[first : first + len(starts)] += np.add.reduceat(score, starts)
            texts.append(first + np.searchsorted(starts, unknown, "right") - 1)
            far.append(events[unknown])
        bounds = np.searchsorted(np.concatenate(texts), np.arange(len(tokens) + 1))
        return own, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(far).view(np.int64)))

    def add(batches):
        number = row_numbers()
        for batch in batches:
            for part in pieces(batch, CHUNK_BYTES // 4):
                tokens = [tokens_of(x) for x in texts_of(part)]
                seen, base, own, rest = of_words(tokens, head.value)
                stream, far = of_streams(tokens, event_head.value)
                columns = {
                    "doc_id": part.column("doc_id"), "train": part.column("train"), "row": pa.array([next(number) for _ in tokens], pa.int64()),
                    "n_tokens": pa.array([len(t) for t in tokens], pa.int64()), "n_known": pa.array(seen.astype(np.int64)),
                    "base_score": pa.array(base), "score": pa.array(own + stream), "rest": rest, "far": far}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    partial = cut(rows.select("doc_id", "text", "train").mapInArrow(
        add, "doc_id long, train boolean, row long, n_tokens long, n_known long, base_score double, score double, "
             "rest array<struct<word:binary,times:int>>, far array<long>"))
    rest = (
        partial.select("row", F.inline("rest")).join(model.words, "word").groupBy("row")
        .agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("k"),
             F.sum(F.col("times") * F.log10((F.col("c") + 0.5) / below)).alias("b"), F.sum(F.col("times") * F.col("logp")).alias("s"))
    )
    if model.events is not None:
        far = partial.select("row", F.explode("far").alias("event")).join(model.events.select("event", "logp"), "event").groupBy("row") \
            .agg(F.sum("logp").alias("f"))
        partial = partial.join(far, "row", "left").withColumn("score", F.col("score") + F.coalesce("f", F.lit(0.0))).drop("f")
    zero = F.lit(0)
    return partial.drop("rest", "far").join(rest, "row", "left").select(
        "doc_id", "train", "n_tokens", (F.col("n_known") + F.coalesce("k", zero)).alias("n_known"),
        (F.col("base_score") + F.coalesce("b", zero)).alias("base_score"), (F.col("score") + F.coalesce("s", zero)).alias("score"))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", across: bool = False) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each input row.

    ``across``: contexts are of the whole text, not of one word. Learned from the rows whose crc32 of the id as text leaves another remainder than 1 modulo 5. A null or empty text is
    the end token alone; a row without an id is a training row; repeated rows are learned and scored each; other columns
    are left aside; an empty table gives an empty one. With no training rows every byte has equal probability.
    """
    rows = text_rows(docs, id_col, text_col).withColumn("train", in_training("doc_id"))
    model = train(rows, across)
    return score(rows, model).select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        "base_score", "score")
