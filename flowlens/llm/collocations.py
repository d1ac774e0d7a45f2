"""Phrase collocations: candidates that are safe by the Apriori rule, counted by double-array tries.

A phrase is as frequent as the rule asks only if all phrases inside it are. So the text is read level by level: words are
counted; pairs of frequent words by a 64-bit key; triples whose pairs have frequent keys; quadruples likewise. What is
frequent goes to the next level as a bitmap of fixed size, whose errors are all on the safe side. Then each place where a
phrase passes gives its window, the longest one that starts there. Equal windows are summed up and dealt in their order to
shards of bounded size. A task builds the trie of its windows' phrases, numpy moves the states of all windows one word on
at a time, and what they carry is added to the accepting states. These counts are the result; the keys only decide what is
counted. The text is read five times, however many phrases there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm import doublearray
from flowlens.llm.common import chunks
from flowlens.session import cut, cut_counted, ship

LONGEST = 4
#: Bits of a level's bitmap, 2 MB whatever the input's size.
BITMAP_BITS = 24
#: Windows of a shard, about; its trie has up to three phrases for each.
SHARD = 1 << 16
CHUNK = 2 << 20
#: Keys are summed up in a task over so much text before they are dealt, windows over so many rows.
SUMMED_BYTES = 16 << 20
SUMMED_ROWS = 1 << 18

WORD, BREAK, GAP = range(3)


def _classes() -> np.ndarray:
    found = np.full(256, WORD, np.uint8)
    found[list(b".,;:!?\n\x0b\x0c\r")] = BREAK
    found[list(b" \t")] = GAP
    return found


CLASSES = _classes()
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


class Words:
    """The words of some texts in order: number of each distinct word, those words, and the piece that each stands in."""

    def __init__(self, texts: list[bytes]):
        data = LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
        kind = CLASSES[data]
        inside = kind == WORD
        edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
        self.numbers, self.distinct = coded.indices.to_numpy(), coded.dictionary
        self.piece = np.cumsum(kind == BREAK, dtype=np.int32)[starts] if len(starts) else np.empty(0, np.int32)

    def together(self, at: np.ndarray, length: int) -> np.ndarray:
        """Those positions whose ``length`` words stand in one piece."""
        at = at[at + length <= len(self.piece)]
        return at[self.piece[at] == self.piece[at + length - 1]]

    def phrase(self, at: np.ndarray, length: int) -> pa.Array:
        words = [self.distinct.take(pa.array(self.numbers[at + i])).cast(pa.string()) for i in range(length)]
        return pc.binary_join_element_wise(*words, " ")


def _rows(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def _by_language(batches) -> Iterator[tuple[str, Words, int]]:
    """Words of some megabytes of text of one language, and how many bytes they are."""
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        texts = batch.column("text").cast(pa.binary())
        for number, lang in enumerate(langs.dictionary.to_pylist()):
            own = texts.filter(pc.equal(langs.indices, number)).to_pylist()
            for a, b in chunks(own, CHUNK):
                yield lang, Words(own[a:b]), sum(map(len, own[a:b]))


def _key_of(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang, 1))


def _mixed(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words
    return keys ^ (keys >> np.uint64(32))


def _place(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def keys_of_words(lang: str, words: list[bytes]) -> np.ndarray:
    each = np.fromiter((xxhash.xxh64_intdigest(x) for x in words), np.uint64, len(words))
    return _mixed(np.full(len(words), _key_of(lang)), each)


class Levels:
    """Where phrases of each length start that are frequent as far as the bitmaps of the levels so far tell."""

    def __init__(self, bitmaps: list[bytes]):
        self.bits = [np.frombuffer(x, np.uint8) for x in bitmaps]

    def _frequent(self, level: int, keys: np.ndarray) -> np.ndarray:
        place = _place(keys)
        return self.bits[level][place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1

    def starts(self, lang: str, words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
        """For lengths 1, 2, ...: (positions, keys) of phrases that pass; the last length has no bitmap yet, so all whose two
        parts pass are there."""
        own = keys_of_words(lang, words.distinct.to_pylist())
        passes = self._frequent(0, own)[words.numbers]
        at = np.flatnonzero(passes)
        keys = own[words.numbers]
        found = [(at, keys[at])]
        for length in range(2, len(self.bits) + 2):
            at, so_far = found[-1]
            both = np.zeros(len(words.numbers) + 1, bool)
            both[at] = True
            keep = both[at + 1]  # the phrase that starts one word later passes too
            at, so_far = at[keep], so_far[keep]
            inside = words.together(at, length)
            so_far = so_far[np.searchsorted(at, inside)]
            joined = _mixed(so_far, keys[inside + length - 1])
            if length <= len(self.bits):
                keep = self._frequent(length - 1, joined)
                inside, joined = inside[keep], joined[keep]
            found.append((inside, joined))
        return found


def count_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, word, n) of all words."""

    def count(batches):
        for lang, words, _ in _by_language(batches):
            times = np.bincount(words.numbers, minlength=len(words.distinct))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(times), pa.string()), words.distinct.cast(pa.string()), pa.array(times, pa.int64())],
                                             ["lang", "word", "n"])

    return _rows(docs, text_col, lang_col).mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def bitmap(places: DataFrame) -> bytes:
    """Bits of (place), of the fixed size of a level."""
    each = 32_768
    rows = places.groupBy(F.bitmap_bucket_number(F.col("place") + 1).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("place") + 1)).alias("bits")).collect()  # 512 rows of 4 KB at most
    whole = bytearray((1 << BITMAP_BITS) // 8)
    for r in rows:
        start = (r["bucket"] - 1) * each // 8
        whole[start : start + len(r["bits"])] = r["bits"]
    return bytes(whole)


def _word_places(frequent: DataFrame) -> DataFrame:
    def place(batches):
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            words = batch.column("word").cast(pa.binary())
            for number, lang in enumerate(langs.dictionary.to_pylist()):
                own = words.filter(pc.equal(langs.indices, number)).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(_place(keys_of_words(lang, own)))], ["place"])

    return frequent.select("lang", "word").mapInArrow(place, "place long")


def frequent_places(docs: DataFrame, bitmaps: list[bytes], least: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Bitmap places of the keys that phrases one word longer than the last level have at least ``least`` times."""
    levels = Levels(bitmaps)

    def summed(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, times = np.unique(np.concatenate([*held, np.empty(0, np.uint64)]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(times.astype(np.int32))], ["key", "n"])

    def count(batches):
        held, read = [], 0
        for lang, words, size in _by_language(batches):
            held.append(levels.starts(lang, words)[-1][1])
            read += size
            if read > SUMMED_BYTES:
                yield summed(held)
                held, read = [], 0
        yield summed(held)

    def place(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_place(batch.column("key").to_numpy().view(np.uint64)))], ["place"])

    keys = _rows(docs, text_col, lang_col).mapInArrow(count, "key long, n int")
    return keys.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("key").mapInArrow(place, "place long")


def _runs(numbers: np.ndarray, at: np.ndarray, length: int, distinct: int) -> tuple[np.ndarray, np.ndarray]:
    """A position of each distinct run of ``length`` numbers among those that start ``at``, and how many start there."""
    same = np.zeros(len(at), np.int64)
    for i in range(length):
        _, same = np.unique(same * distinct + numbers[at + i], return_inverse=True)
    _, first, times = np.unique(same, return_index=True, return_counts=True)
    return at[first], times


def windows(docs: DataFrame, bitmaps: list[bytes], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, n): the longest phrase that passes all bitmaps at each place where one of two words does, and at how many
    places it is the longest.

    The parts of a phrase that passes pass too, so a phrase occurs as often as the windows that begin with it.
    """
    levels = Levels(bitmaps)

    def longest(lang: str, words: Words) -> Iterator[pa.Table]:
        found = levels.starts(lang, words)[: len(bitmaps)]
        for length in range(len(found), 1, -1):
            at = found[length - 1][0]
            if length < len(found):
                at = np.setdiff1d(at, found[length][0], assume_unique=True)
            if len(at):
                first, times = _runs(words.numbers, at, length, len(words.distinct))
                yield pa.table({"lang": pa.array([lang] * len(first), pa.string()), "phrase": words.phrase(first, length), "n": pa.array(times, pa.int64())})

    def summed(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        if held:
            rows = pa.concat_tables(held).group_by(["lang", "phrase"]).aggregate([("n", "sum")])
            yield from rows.select(["lang", "phrase", "n_sum"]).rename_columns(["lang", "phrase", "n"]).to_batches(max_chunksize=1 << 15)

    def gather(batches):
        held, rows = [], 0
        for lang, words, _ in _by_language(batches):
            for table in longest(lang, words):
                held.append(table)
                rows += table.num_rows
            if rows > SUMMED_ROWS:
                yield from summed(held)
                held, rows = [], 0
        yield from summed(held)

    return _rows(docs, text_col, lang_col).mapInArrow(gather, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


class Shard:
    """Trie of the phrases of two words and more that some distinct windows begin with, each behind its language."""

    def __init__(self, rows: list[tuple[str, str]]):
        split = [phrase.split(" ") for _, phrase in rows]
        times: dict[str, int] = {}
        for words in split:
            for word in words:
                times[word] = times.get(word, 0) + 1
        lexicon = sorted(times, key=lambda x: (-times[x], x))  # low numbers for common words keep children together
        number = {word: i for i, word in enumerate(lexicon, 1)}
        langs = {lang: i for i, lang in enumerate(sorted({lang for lang, _ in rows}), 1)}
        symbols = np.zeros((len(rows), LONGEST + 1), np.int64)
        for i, ((lang, _), words) in enumerate(zip(rows, split, strict=True)):
            symbols[i, 0] = langs[lang]
            symbols[i, 1 : len(words) + 1] = [number[x] for x in words]
        largest = max(len(lexicon), len(langs))
        self.windows = doublearray.digits(symbols, largest)
        begun: dict[tuple[str, str], int] = {}  # each phrase and a window that begins with it
        lengths = []
        for i, ((lang, _), words) in enumerate(zip(rows, split, strict=True)):
            for length in range(2, len(words) + 1):
                if begun.setdefault((lang, " ".join(words[:length])), i) == i:
                    lengths.append(length)
        phrases = symbols[list(begun.values())]
        phrases[np.arange(LONGEST + 1) > np.array(lengths, np.int64)[:, None]] = 0
        self.trie = doublearray.build(doublearray.digits(phrases, largest).reshape(len(phrases), -1))
        self.lang = pa.array([lang for lang, _ in begun], pa.string())
        self.phrase = pa.array([phrase for _, phrase in begun], pa.string())

    def count(self, n: np.ndarray) -> np.ndarray:
        """How often each phrase occurs, the windows occurring ``n`` times."""
        times = np.zeros(len(self.phrase), np.int64)
        at, states = np.arange(len(n)), np.zeros(len(n), np.int64)
        for place in range(LONGEST + 1):
            for digit in range(self.windows.shape[2]):
                states = self.trie.advance(states, self.windows[at, place, digit])
                at, states = at[states >= 0], states[states >= 0]
            accepted = self.trie.accept[states]
            np.add.at(times, accepted[accepted >= 0], n[at[accepted >= 0]])
        return times


def count_phrases(found: DataFrame, n: int) -> DataFrame:
    """(lang, phrase, a): occurrences of all phrases that the ``n`` distinct windows (lang, phrase, n) begin with."""

    def total(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        shard = Shard(list(zip(table["lang"].to_pylist(), table["phrase"].to_pylist(), strict=True)))
        times = shard.count(table["n"].to_numpy())
        yield pa.RecordBatch.from_arrays([shard.lang, shard.phrase, pa.array(times)], ["lang", "phrase", "a"])

    def count(batches):
        held, rows = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, SHARD):
                held.append(batch.slice(start, SHARD))
                rows += held[-1].num_rows
                if rows >= SHARD:
                    yield from total(held)
                    held, rows = [], 0
        if held:
            yield from total(held)

    dealt = found.repartitionByRange(max(1, -(-n // SHARD)), "lang", "phrase")
    return dealt.mapInArrow(count, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def _exact(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(20,0)")


def score_of() -> Column:
    """floor(2000000 a / (l + r)) of the columns a, l and r."""
    return F.expr("(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0))) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")


def mine(docs: DataFrame, least: int = 30, top: int = 2000, share: int = 80, id_col: str = "doc_id", text_col: str = "text",
         lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of two to four words.

    ``a``: occurrences, ``l`` and ``r`` those of the two parts at the cut with the lowest score floor(2000000 a / (l + r)), ``n``
    all words of the language. A phrase inside a longer candidate with ``share`` percent of its occurrences is left out; it
    lies in one that is a single word longer, for every phrase between two candidates is one itself. Products are decimals
    of 38 digits. A null text holds no words, a null language is ``und``; ids play no part, so null and repeated ones do no
    harm and repeated rows count each; ties are ordered by phrase; words and texts of any length take part whole; other
    columns are left aside; an empty table gives no rows.
    """
    words = cut(count_words(docs, text_col, lang_col))
    frequent = words.filter(F.col("n") >= least)
    bitmaps = [bitmap(_word_places(frequent))]
    for _ in range(2, LONGEST + 1):
        bitmaps.append(bitmap(frequent_places(docs, bitmaps, least, text_col, lang_col)))
    found = cut(count_phrases(*cut_counted(windows(docs, bitmaps, text_col, lang_col))).filter(F.col("a") >= least))

    split = F.split("phrase", " ")
    parts = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.struct(
        k.alias("k"), F.array_join(F.slice("words", F.lit(1), k), " ").alias("left"),
        F.array_join(F.slice("words", k + 1, F.size("words")), " ").alias("right")))
    cuts = found.withColumn("words", split).select("lang", "phrase", "a", F.explode(parts).alias("p")).select("lang", "phrase", "a", "p.*")
    known = found.unionByName(frequent.select("lang", F.col("word").alias("phrase"), F.col("n").alias("a")))
    of = lambda side, name: known.select("lang", F.col("phrase").alias(side), F.col("a").alias(name))
    scored = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]).withColumn("score", score_of()) \
        .groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("best")).select("lang", "phrase", "best.*")

    longer = found.withColumn("words", split).filter(F.size("words") > 2).select(
        "lang", F.col("a").alias("longer"), F.explode(F.array(
            F.array_join(F.slice("words", F.lit(1), F.size("words") - 1), " "),
            F.array_join(F.slice("words", F.lit(2), F.size("words")), " "))).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(most, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (F.lit(100) * _exact("longer") < F.lit(share) * _exact("a")))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
