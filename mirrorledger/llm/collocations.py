"""Phrase collocation mining by stripes: each prefix keys a counter of its next words.

Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends, and pieces into words at blanks and tabs. A
stripe is (lang, prefix, next words, counts). Tasks add up stripes in memory and send them by prefix, where they are merged
element by element, by an aggregate that can spill. Merged stripes hold all that is asked for: their entries are the phrases
one word longer; the entry of a prefix in the stripe one word shorter is the prefix's own number; the largest entry tells whether an
extension to the right subsumes the prefix, and entries regrouped without their first word tell the same to the left. A subsuming phrase longer by several words has one longer by a single word inside it that occurs as
often, so single words suffice.

Texts are dealt to one task for each core, as every task sends stripes of nearly all frequent prefixes; one whose counters are
full sends them and goes on. Three scans for stripes: of the empty prefix (words), of one-word prefixes, of two to four words. A phrase can be frequent only
if its words and its word pairs are, so each scan asks a bit set of fixed size for the frequent words or pairs of the scan
before. Ahead of the second and third, a scan counts the same places by hash only, in a table of counters of fixed size for
each task. The tables are added up, and a phrase whose counter stays below the least count is in no stripe, nor is one that
holds such a phrase. As more phrases than these tables have room for let only more stripes through, results never depend on them. The stripes of the
empty prefix and of prefixes made of very common words are dealt in parts by next word, so none meets in one task. Phrases are counted as themselves, not by hashes; sums are 64-bit, scores 38-digit integers.

``lang`` null counts as ``und``, a null text as empty; a text of any length is read whole, in slices of texts. Repeated rows
count as often as they occur. Ties in score and count rank by the phrase's UTF-8 bytes. Empty tables give empty results. Only
``text`` and ``lang`` are read, so other columns may have any name.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.skew import lookup
from ..workspace import materialise
from .rows import hash_filter, passes
from .wordbytes import Words, all_but, mix, sliced, text_hash

MIN_COUNT = 100
LONGEST = 5
TOP = 2000
UNKNOWN = "und"
FILTER_BITS = 22
COUNTER_BITS = 24  # of a task's counters by hash at most, a byte each
COUNTER_WORDS = 8  # words for each counter, where that makes fewer
COUNTER_PART = 16  # bits of the counters that are sent in one row
COUNTER_TASKS = 64  # that add the counters up
WORD_PARTS = 1024  # of the empty prefix's stripe
HOT_SHARE = 1e-4  # of all words; at most 1 / HOT_SHARE words can have it, which bounds the list that is broadcast
HOT_PARTS = 8  # of the stripe of a prefix that is made of hot words alone; others are sent as one
HELD_WORDS = 250_000  # different words that a task gathers before it sends their counts
HELD = 500_000  # entries of longer prefixes that it gathers as numbers, with at most HELD_NODES prefixes
HELD_NODES = 100_000
EMITTED = 50_000
SLICE = 1 << 20  # bytes of text that are cut into words together

_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_IS_WORD = all_but(_SEPARATORS + b" \t")
_ENDS_PIECE = ~all_but(_SEPARATORS)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
STRIPE = "key bigint, lang string, prefix string, words int, nexts array<string>, counts array<bigint>"
STRIPE_COLUMNS = [c.split()[0] for c in STRIPE.split(", ")]


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * _SPREAD + second)


def word_hash(langs: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(langs * _SPREAD ^ words)


class Places:
    """The words of a slice of texts, with codes for equal (lang, word) and which neighbours stand in one piece."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        words = Words(texts, _IS_WORD)
        n = len(words)
        inside = _IS_WORD[words.lower]
        offsets = np.zeros(n + 1, np.int64)
        np.cumsum(words.ends - words.starts, out=offsets[1:])
        plain = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets), pa.py_buffer(words.lower[inside])])
        coded = plain.dictionary_encode()
        named = langs.cast(pa.large_string()).dictionary_encode()
        self.langs, doc = named.dictionary, words.doc
        lang = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)[doc]
        spelled = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.codes = spelled * max(1, len(self.langs)) + lang
        self.lang = lang
        self.spelled = coded.dictionary
        self.hashes = word_hash(text_hash(self.langs)[lang], text_hash(self.spelled)[spelled])
        ends = np.cumsum(_ENDS_PIECE[words.lower])
        piece = ends[words.starts]
        self.joined = np.zeros(n, bool)
        self.joined[:-1] = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1])

    def __len__(self) -> int:
        return len(self.codes)

    def tokens(self) -> pa.Table:
        """Counts of the different words, as entries of the empty prefix."""
        _, first, count = np.unique(self.codes, return_index=True, return_counts=True)
        lang, word = self.named(first)
        empty, zero = pa.array([""] * len(first), pa.large_string()), pa.array(np.zeros(len(first), np.int32))
        return pa.table([lang, empty, zero, word, pa.array(count)], names=["lang", "prefix", "words", "next", "n"])

    def named(self, at: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Language and spelling of the words at some places."""
        return self.langs.take(pa.array(self.lang[at])), self.spelled.take(pa.array(self.codes[at] // max(1, len(self.langs))))


class Counters:
    """A task's stripes: words and prefixes by number, entries (prefix, next word) as sorted integers with their counts."""

    def __init__(self, hot: set[tuple[str, str]]):
        self.hot = hot
        self.word_of: dict[tuple, int] = {}
        self.langs, self.words = [], []
        self.node_of: dict[int, int] = {}  # of a prefix and the word that makes it one longer
        self.texts, self.node_langs, self.lengths, self.parts = [], [], [], []
        self.keys, self.counts = [], []
        self.rows = 0

    def word_ids(self, places: Places, at: np.ndarray) -> np.ndarray:
        _, first, code = np.unique(places.codes[at], return_index=True, return_inverse=True)
        ids = np.empty(len(first), np.int64)
        for k, name in enumerate(zip(*(c.to_pylist() for c in places.named(at[first])), strict=True)):
            known = self.word_of.get(name)
            if known is None:
                known = self.word_of[name] = len(self.words)
                self.langs.append(name[0])
                self.words.append(name[1])
            ids[k] = known
        return ids[code]

    def nodes(self, before: np.ndarray | None, word: np.ndarray) -> np.ndarray:
        """Numbers of the prefixes that ``word`` makes of the prefixes ``before`` (of the empty one if None)."""
        longer = (word if before is None else ((before + 1) << 32) | word).astype(np.int64)
        each, code = np.unique(longer, return_inverse=True)
        ids = np.empty(len(each), np.int64)
        for k, key in enumerate(each.tolist()):
            known = self.node_of.get(key)
            if known is None:
                known = self.node_of[key] = len(self.texts)
                parent, last = (key >> 32) - 1, key & 0xFFFFFFFF
                self.texts.append(self.words[last] if parent < 0 else f"{self.texts[parent]} {self.words[last]}")
                self.node_langs.append(self.langs[last])
                self.lengths.append(1 if parent < 0 else self.lengths[parent] + 1)
                common = (self.langs[last], self.words[last]) in self.hot and (parent < 0 or self.parts[parent] > 1)
                self.parts.append(HOT_PARTS if common else 1)
            ids[k] = known
        return ids[code]

    def add(self, node: np.ndarray, following: np.ndarray) -> None:
        """Counts places by prefix and next word."""
        keys, counts = np.unique((node << 32) | following, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.rows += len(keys)

    def combine(self) -> None:
        if len(self.keys) > 1:
            keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
            counts = np.bincount(at, np.concatenate(self.counts), minlength=len(keys)).astype(np.int64)
            self.keys, self.counts, self.rows = [keys], [counts], len(keys)

    def stripes(self) -> Iterator[pa.RecordBatch]:
        self.combine()
        if not self.rows:
            return
        text = lambda x: pa.array(x, pa.large_string())
        prefixes, langs, nexts = text(self.texts), text(self.node_langs), text(self.words)
        lengths, parts = np.array(self.lengths, np.int32), np.array(self.parts, np.uint64)
        prefix_hash, next_hash = word_hash(text_hash(langs), text_hash(prefixes)), text_hash(nexts)
        for begin in range(0, self.rows, EMITTED):
            keys, counts = self.keys[0][begin : begin + EMITTED], self.counts[0][begin : begin + EMITTED]
            node, following = keys >> 32, keys & 0xFFFFFFFF
            part = next_hash[following] % parts[node]
            order = np.lexsort((part, node))
            node, part, following, counts = node[order], part[order], following[order], counts[order]
            opens = np.ones(len(node), bool)
            opens[1:] = (node[1:] != node[:-1]) | (part[1:] != part[:-1])
            at = np.flatnonzero(opens)
            row, offsets = pa.array(node[at]), pa.array(np.append(at, len(node)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (nexts.take(pa.array(following)), pa.array(counts))]
            key = pa.array(mix(prefix_hash[node[at]] + part[at]).view(np.int64))
            columns = [key, langs.take(row), prefixes.take(row), pa.array(lengths[node[at]]), *lists]
            yield from _typed(pa.table(columns, names=STRIPE_COLUMNS), STRIPE_COLUMNS)


def _added(tables: list[pa.Table]) -> pa.Table:
    keys = [c for c in tables[0].column_names if c != "n"]
    return pa.concat_tables(tables).group_by(keys, use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})


def _token_stripes(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Stripes of the empty prefix from counted words."""
    lang, word = (table.column(c).combine_chunks() for c in ("lang", "next"))
    lang_hash, part = text_hash(lang), text_hash(word) % np.uint64(WORD_PARTS)
    order = np.lexsort((part, lang_hash))
    rows = table.take(pa.array(order))
    key = mix(lang_hash + part)[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
    offsets = pa.array(np.append(at, len(key)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, rows.column(c).combine_chunks()) for c in ("next", "n")]
    heads = [rows.column(c).take(pa.array(at)) for c in ("lang", "prefix", "words")]
    yield from _typed(pa.table([pa.array(key[at].view(np.int64)), *heads, *lists], names=STRIPE_COLUMNS), STRIPE_COLUMNS)


def _typed(table: pa.Table, names: list[str]) -> Iterator[pa.RecordBatch]:
    kinds = {"key": pa.int64(), "words": pa.int32(), "nexts": pa.list_(pa.string()), "counts": pa.list_(pa.int64())}
    fields = pa.schema([(n, kinds.get(n, pa.string())) for n in names])
    yield from table.select(names).cast(fields).combine_chunks().to_batches(max_chunksize=20_000)


def _longer(places: Places, lengths: list[int], known: np.ndarray, often: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each prefix length the places where phrases one word longer begin, and their hashes. Both phrases that such a
    phrase holds and that are one word shorter were let through, by ``known`` (see ``stripes``) or by ``often``."""
    h, ok = places.hashes, places.joined.copy()
    if lengths == [1]:
        good = passes(known, h)
        ok[:-1] &= good[:-1] & good[1:]
    else:
        ok[:-1] &= passes(known, pair_hash(h[:-1], h[1:]))
    at = np.flatnonzero(ok)
    hashes = pair_hash(h[at], h[np.minimum(at + 1, len(h) - 1)])
    for words in lengths:
        if words > 1:
            follows = ok[at + 1]
            at = at[follows]
            hashes = pair_hash(hashes[follows], h[at + words])
        if often is not None:
            some = passes(often, hashes)
            at, hashes = at[some], hashes[some]
        if not len(at):
            return
        yield words, at, hashes
        ok = np.zeros(len(places), bool)
        ok[at] = True


def counter_bits(total: int) -> int:
    return max(6, min(COUNTER_BITS, (total // COUNTER_WORDS).bit_length()))


def often_by_hash(docs: DataFrame, lengths: list[int], known: np.ndarray, min_count: int, bits: int) -> np.ndarray:
    """A bit set of the hashes that phrases occurring ``min_count`` times have, and of those that share a counter with them.

    A task counts in ``2**bits`` counters, each up to ``min_count``, which keeps whether a sum reaches it."""
    least, part_bits = max(1, min_count), min(bits, COUNTER_PART)
    kind = np.min_scalar_type(least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << bits, kind)
        for batch in batches:
            for piece in sliced(batch, limit=SLICE):
                places = Places(piece.column("lang"), piece.column("text"))
                for _, _, hashes in _longer(places, lengths, known) if len(places) else ():
                    slots, n = np.unique(hashes >> np.uint64(64 - bits), return_counts=True)
                    slots = slots.astype(np.int64)
                    counters[slots] = np.minimum(least, counters[slots] + n)
        for part, some in enumerate(counters.reshape(-1, 1 << part_bits)):
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([some.tobytes()], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts"), strict=True):
                held = total.setdefault(part, np.zeros(1 << part_bits, np.uint64))
                held += np.frombuffer(counts.as_buffer(), kind)
        for part, counts in total.items():
            found = np.packbits(counts >= least, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([found], pa.binary())], names=["part", "bits"])

    counted = docs.mapInArrow(count, "part int, counts binary").repartition(COUNTER_TASKS, "part")
    table = np.zeros((1 << (bits - part_bits), 1 << (part_bits - 6)), np.uint64)
    for row in counted.mapInArrow(add, "part int, bits binary").collect():
        table[row["part"]] = np.frombuffer(row["bits"], np.uint64)
    return table.ravel()


def stripes(
    docs: DataFrame, lengths: list[int], known: np.ndarray | None = None, hot: set[tuple[str, str]] = frozenset(), often: np.ndarray | None = None
) -> DataFrame:
    """Stripes of the prefixes of ``lengths`` words (0; 1; or 2, 3 and 4), added up within a task. ``known`` lets frequent
    words (for 1) or word pairs (for more) through, ``often`` hashes of phrases; ``hot`` names very common words by language."""

    def count(places: Places, counters: Counters) -> None:
        found = list(_longer(places, lengths, known, often))
        if not found:
            return
        words, at, _ = found[0]  # the longer ones lie inside these
        used = np.unique(np.concatenate([at + k for k in range(words + 1)]))
        ids, nodes = np.full(len(places), -1, np.int64), np.empty(len(places), np.int64)
        ids[used] = counters.word_ids(places, used)
        nodes[at] = counters.nodes(None, ids[at])
        for k in range(1, words):
            nodes[at] = counters.nodes(nodes[at], ids[at + k])
        for longer, at, _ in found:
            if longer > words:
                nodes[at] = counters.nodes(nodes[at], ids[at + longer - 1])
            counters.add(nodes[at], ids[at + longer])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, full = Counters(hot), False
        for batch in batches:
            for piece in sliced(batch, limit=SLICE):
                places = Places(piece.column("lang"), piece.column("text"))
                if len(places):
                    count(places, counters)
                if counters.rows > 2 * HELD:
                    counters.combine()
                    full = counters.rows > HELD
                if full or len(counters.texts) > HELD_NODES:
                    yield from counters.stripes()
                    counters, full = Counters(hot), False
        yield from counters.stripes()

    def scan_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for piece in sliced(batch, limit=SLICE):
                held.append(Places(piece.column("lang"), piece.column("text")).tokens())
                rows += held[-1].num_rows
                if rows > 2 * HELD_WORDS:
                    held = [_added(held)]
                    rows = held[0].num_rows
                    if rows > HELD_WORDS:
                        yield from _token_stripes(held[0])
                        held, rows = [], 0
        if rows:
            yield from _token_stripes(_added(held))

    if lengths == [0]:
        return docs.mapInArrow(scan_words, STRIPE)
    return docs.mapInArrow(scan, STRIPE)


def merged(rows: DataFrame, min_count: int) -> DataFrame:
    """lang, prefix, words, total, stripe: added element by element where the rows of a part have met, in one shuffle.
    Entries below ``min_count`` remain only in the total."""
    part = ["key", "lang", "prefix", "words"]
    each = rows.repartition("key").select(*part, F.inline(F.arrays_zip("nexts", "counts")))
    added = each.groupBy(*part, F.col("nexts").alias("next")).agg(F.sum("counts").alias("n"))
    large = F.when(F.col("n") >= min_count, F.struct("next", "n"))
    return added.groupBy(*part).agg(F.sum("n").alias("total"), F.collect_list(large).alias("stripe")).drop("key")


def _hashed(phrases: DataFrame, pairs: bool) -> DataFrame:
    """h: what ``stripes`` asks its filter for, of rows (lang, prefix, next)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, prefix, following = (text_hash(batch.column(c)) for c in ("lang", "prefix", "next"))
            h = pair_hash(word_hash(lang, prefix), word_hash(lang, following)) if pairs else word_hash(lang, following)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    return phrases.select("lang", "prefix", "next").mapInArrow(run, "h bigint")


def entries(found: DataFrame) -> DataFrame:
    """lang, prefix, next, words (of the whole phrase), a: one row for each entry of the stripes."""
    each = found.select("lang", "prefix", "words", F.inline("stripe"))
    return each.select("lang", "prefix", "next", (F.col("words") + 1).alias("words"), F.col("n").alias("a"))


#: floor(1000 a n / (l r)) in integers of up to 38 digits.
SCORE = (
    "(CAST(a AS DECIMAL(19,0)) * CAST(1000 AS DECIMAL(4,0)) * CAST(n AS DECIMAL(19,0)))"
    " div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"
)


def mine(docs: DataFrame, min_count: int = MIN_COUNT, top: int | None = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``top`` collocations of each language (all if None)."""
    # A task sends each of its prefixes once, so a core reads its share in one task, however many parts the input has.
    docs = docs.coalesce(docs.sparkSession.sparkContext.defaultParallelism)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))
    words, _ = materialise(merged(stripes(texts, [0]), min_count), "words")
    sizes = words.groupBy("lang").agg(F.sum("total").alias("n"))
    known = hash_filter(_hashed(entries(words), False), "h", FILTER_BITS)
    total = sizes.agg(F.sum("n").alias("n")).first()["n"] or 0
    common = entries(words).where(F.col("a") >= max(1, total * HOT_SHARE)).select("lang", "next")
    hot = {tuple(r) for r in common.collect()}
    bits = counter_bits(total)
    often = often_by_hash(texts, [1], known, min_count, bits)
    ones, _ = materialise(merged(stripes(texts, [1], known, hot, often), min_count), "stripes")
    known, prefixes = hash_filter(_hashed(entries(ones), True), "h", FILTER_BITS), list(range(2, LONGEST))
    often = often_by_hash(texts, prefixes, known, min_count, bits)
    more, _ = materialise(merged(stripes(texts, prefixes, known, hot, often), min_count), "stripes")

    found = entries(ones.unionByName(more)).withColumn("phrase", F.concat_ws(" ", "prefix", "next"))
    phrases, n_phrases = materialise(found, "phrases")
    totals = entries(words).select("lang", F.col("next").alias("prefix"), F.col("a").alias("f"))
    totals = totals.unionByName(phrases.where(F.col("words") < LONGEST).select("lang", F.col("phrase").alias("prefix"), F.col("a").alias("f")))
    longer = phrases.where("words > 2")
    tail = F.expr("substring(phrase, instr(phrase, ' ') + 1)")
    wider = longer.select("lang", F.col("prefix").alias("phrase"), "a").unionByName(longer.select("lang", tail.alias("phrase"), "a"))
    wider = wider.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = phrases.join(wider, ["lang", "phrase"], "left").where("most IS NULL OR most < a").select("lang", "phrase", "words", "a")

    cuts = kept.withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("first"), F.expr("substring_index(phrase, ' ', k - words)").alias("rest"))
    n_cuts = n_phrases * (LONGEST - 1)
    for part, name in (("first", "l"), ("rest", "r")):
        side = totals.select("lang", F.col("prefix").alias(part), F.col("f").alias(name))
        cuts = lookup(cuts, side, ["lang", part], spread_by=F.col("phrase"), left_rows=n_cuts, how="inner")
    cuts = cuts.join(sizes, "lang").withColumn("score", F.expr(SCORE))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("bigint"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
