"""Collocations: phrases whose words stand together more often than their parts do, by suffix automata and global counts.

A shard is the words of some documents of one language in one task. Its generalised suffix automaton is bounded to
phrases of LONGEST words: phrases that end at the same places are one state, whose endpos count they share, and a
state's suffix link leads to the longest of its phrases' suffixes that ends at more places. All phrases of a state
are suffixes of its longest. The states are made level by level in numpy: the phrases of k + 1 words that end at a place
are numbered by the number of the phrase of k words before it and the word, so a phrase also knows its prefix, the source
of the transition that makes it.

A shard enumerates its phrases with their states' counts, as lists by prefix; Spark adds them up over all shards. In
the whole corpus a candidate's suffix (the suffix link) and prefix (the transition's source) lie inside it, and
their counts against its own tell what it subsumes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import map_batches, materialize

LONGEST = 3
LEAST = 10
SUBSUMED = 50
TOP = 2000
SCALE = 1_000_000
#: Words of a task's shards together; then they are given out and new ones begin.
SHARD_WORDS = 5 << 19
SHARD_BYTES = 1 << 26
SEGMENT = 1 << 20
CODED = 1 << 16
GIVEN = 1 << 16
SALTS = 16
SHARE, SAMPLE = 4096, 1 << 12

# fixed values: what ends a piece, and what parts words
_ENDS = b".,;:!?\n\x0b\x0c\r"
_END = b"."
_MARKS = bytes.maketrans(_ENDS, _END * len(_ENDS))
PHRASES = "lang string, head binary, salt int, tails binary"


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased, with a "." wherever a piece ends; a long text goes in lists that are cut between words."""
    at = 0
    while at < len(text):
        end = at + SEGMENT
        while end < len(text) and text[end] not in b" \t" and text[end] not in _ENDS:
            end += 1
        yield text[at:end].lower().translate(_MARKS).replace(_END, b" . ").split()
        at = end


class Shard:
    """Words of one language, and the states of their bounded automaton."""

    def __init__(self, before: list[bytes] | None = None):
        #: words that end no phrase here, as they have been counted where they came from
        self.before = before or []
        self.held, self.parts, self.words, self.bytes = list(self.before), [], len(self.before), 0

    def add(self, words: list[bytes], size: int = 0) -> None:
        self.held += words
        self.words += len(words)
        self.bytes += size
        if len(self.held) >= CODED:
            self._code()

    def _code(self) -> None:
        self.parts.append(pa.array(self.held, pa.binary()).dictionary_encode())
        self.tail = self.held[-(LONGEST - 1) :]
        self.held = []

    def after(self) -> Shard:
        """An empty shard that goes on inside the document where this one ends."""
        return Shard((getattr(self, "tail", []) + self.held)[-(LONGEST - 1) :])

    def levels(self) -> None:
        """Number all phrases: by level k, at[k] has at each place the number of the phrase of k + 1 words that ends there (-1: none);
        of each phrase, place[k] has a place where it ends and count[k] its endpos count. All of 32 bits."""
        if self.held or not self.parts:
            self._code()
        coded = pa.chunked_array(self.parts).unify_dictionaries()
        self.names, self.word = coded.chunk(0).dictionary, np.concatenate([c.indices.to_numpy() for c in coded.chunks])
        word, mark = self.word, pc.index(self.names, pa.scalar(_END, pa.binary())).as_py()
        inside, fresh = word != mark, np.arange(len(word)) >= len(self.before)
        self.total = int((inside & fresh).sum())
        self.parts = []
        self.at, self.place, self.count = [], [], []
        for k in range(LONGEST):
            if k == 0:
                ends = np.flatnonzero(inside)
                key = word[ends]
            else:
                ends = ends[(ends > 0) & (self.at[-1][ends - 1] >= 0)]
                key = self.at[-1][ends - 1].astype(np.int64) * len(self.names) + word[ends]
            # numbers run by first place, so that a phrase's first is where the highest number so far grows
            number = pa.array(key).dictionary_encode().indices.to_numpy()
            first = np.flatnonzero(np.diff(np.maximum.accumulate(number), prepend=-1)) if len(number) else number
            here = np.full(len(word), -1, np.int32)
            here[ends] = number
            self.at.append(here)
            self.place.append(ends[first].astype(np.int32))
            self.count.append(np.bincount(number[fresh[ends]], minlength=len(first)).astype(np.int32))

    def states(self) -> list[tuple[list[str], int, int]]:
        """(longest phrase, words of the shortest, endpos count) of each state; its suffix link leads to the phrase of one word less than the shortest."""
        self.levels()
        least, longest = [np.full(len(c), k + 1) for k, c in enumerate(self.count)], [c > 0 for c in self.count]
        for k in range(1, LONGEST):
            # the suffix of one word less ends at the same place; a phrase that ends wherever it does is in one state with it
            suffix = self.at[k - 1][self.place[k]]
            same = self.count[k] == self.count[k - 1][suffix]
            least[k][same] = least[k - 1][suffix[same]]
            longest[k - 1][suffix[same]] = False
        words = lambda k, p: [self.names[self.word[self.place[k][p] - j]].as_py().decode() for j in range(k, -1, -1)]
        return [(words(k, p), int(least[k][p]), int(self.count[k][p])) for k in range(LONGEST) for p in np.flatnonzero(longest[k]).tolist()]

    def phrases(self, common: pa.Array | None = None) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array]]:
        """(heads, salts, tails): each head (all words but the last) once a level, with its last words, parted by spaces, each followed by a tab and its count if that is not 1.

        A head among `common` comes up to SALTS times, with the words of one salt each time.
        """
        self.levels()
        salt_of = np.fromiter((zlib.crc32(w) % SALTS for w in self.names.to_pylist()), np.int64, len(self.names)) if common is not None and len(common) else None
        for k in range(LONGEST):
            own = np.flatnonzero(self.count[k])
            if not len(own):
                continue
            places, counts = self.place[k][own], self.count[k][own]
            many = pc.if_else(pa.array(counts != 1), pc.binary_join_element_wise(pa.scalar(b"\t"), pa.array(counts).cast(pa.string()).cast(pa.binary()), b""), pa.scalar(b""))
            if k == 0:
                yield self.names.take(pa.array(self.word[places])), np.zeros(len(own), np.int64), many
                continue
            prefix = self.at[k - 1][places - 1].astype(np.int64)
            if salt_of is not None:
                heads = self._joined(self.place[k - 1], k)
                often = pc.is_in(heads, value_set=common).to_numpy(zero_copy_only=False)
                prefix = prefix * SALTS + np.where(often[prefix], salt_of[self.word[places]], 0)
            order = np.argsort(prefix, kind="stable")
            start = np.flatnonzero(np.diff(prefix[order], prepend=-1))
            last = pc.binary_join_element_wise(self.names.take(pa.array(self.word[places])), many, b"").take(pa.array(order))
            lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(order)), pa.int32()), last)
            salts = prefix[order[start]] % SALTS if salt_of is not None else np.zeros(len(start), np.int64)
            yield self._joined(places[order[start]] - 1, k), salts, pc.binary_join(lists, b" ")

    def _joined(self, ends: np.ndarray, size: int) -> pa.Array:
        """The phrases of so many words that end at these places."""
        parts = [self.names.take(pa.array(self.word[ends - j])) for j in range(size - 1, -1, -1)]
        return pc.binary_join_element_wise(*parts, b" ") if size > 1 else parts[0]


def _given_out(shards: dict[str, Shard], common: dict[str, pa.Array]) -> Iterator[dict]:
    while shards:  # each goes once it has been given out
        lang, shard = shards.popitem()
        for heads, salts, tails in shard.phrases(common.get(lang)):
            for s in range(0, len(heads), GIVEN):
                yield {"lang": pa.array([lang] * len(heads[s : s + GIVEN])), "head": heads[s : s + GIVEN], "salt": pa.array(salts[s : s + GIVEN], pa.int32()), "tails": tails[s : s + GIVEN]}
        yield {"lang": [lang], "head": [b""], "salt": [0], "tails": [b"\t%d" % shard.total]}
        del shard
        pa.default_memory_pool().release_unused()


def shard_phrases(batches: Iterator[pa.RecordBatch], common: list[tuple[str, str]] = ()) -> Iterator[dict]:
    """Rows (lang, x: a text's bytes) of one task to the phrases of its shards, a shard for each language at a time; of each its words as an empty phrase.

    common: the (lang, head) whose phrases are dealt by their last words.
    """
    often: dict[str, list[bytes]] = {}
    for lang, head in common:
        often.setdefault(lang, []).append(head.encode())
    sets = {lang: pa.array(heads, pa.binary()) for lang, heads in often.items()}
    shards: dict[str, Shard] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("x"), strict=True):
            for words in tokens(text.as_py()):
                shard = shards.setdefault(lang, Shard())
                shard.add(words, sum(map(len, words)))
                if sum(s.words for s in shards.values()) >= SHARD_WORDS or sum(s.bytes for s in shards.values()) >= SHARD_BYTES:
                    shards, full = {lang: shard.after()}, shards
                    del shard
                    yield from _given_out(full, sets)
            if lang in shards:
                shards[lang].add([_END])
    yield from _given_out(shards, sets)


def phrase_lists(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", common: list[tuple[str, str]] = ()) -> DataFrame:
    """(head, salt, tails) of all shards: head is all words but the last, a line end and the lang, salt and tails as phrases() gives them. A phrase has no line end, so the first one parts them."""
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("x"))
    lists = map_batches(rows, lambda batches: shard_phrases(batches, common), PHRASES)
    return lists.select(F.concat(F.col("head").cast("string"), F.lit("\n"), "lang").alias("head"), "salt", F.col("tails").cast("string").alias("tails"))


def _words(phrase: Column, many: Column) -> Column:
    """The first so many words of a phrase, or the last if the number is under 0."""
    return F.call_function("substring_index", phrase, F.lit(" "), many)


def common_heads(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """The (lang, head) that begin one in SHARE or more of the phrases of a sample of documents (SAMPLE of 2^20 by a hash of the text, whole texts), so SHARE at most.

    They only say which heads' phrases are dealt to many tasks; no count depends on them.
    """
    some = docs.where(F.pmod(F.xxhash64(F.col(f"`{text_col}`")), F.lit(1 << 20)) < SAMPLE)
    many = materialize(phrase_lists(some, text_col, lang_col).groupBy("head").agg(F.sum(F.size(F.split("tails", " "))).alias("n")), "heads")
    total = many.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = [r["head"].split("\n", 1) for r in many.where((F.col("n") * SHARE >= total) & (F.col("n") > 1)).select("head").collect()]
    return [(lang, head) for head, lang in found if head]


def phrase_counts(docs: DataFrame, least: int = LEAST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, size, phrase, f): phrases of LONGEST words at most with at least `least` occurrences, and of each lang all its words as size 0.

    Phrases with one head go to one task, as lists, but for the common heads, whose phrases are dealt to SALTS tasks by
    their last word. A shard has each phrase once, so nothing is to be gained by adding up before the shuffle.
    """
    word = lambda e: F.substring_index(e, "\t", 1)
    dealt = phrase_lists(docs, text_col, lang_col, common_heads(docs, text_col, lang_col)).repartition("head", "salt")
    each = dealt.select("head", "salt", F.explode(F.split("tails", " ")).alias("e"))
    f = F.when(F.contains("e", F.lit("\t")), F.substring_index("e", "\t", -1).cast("long")).otherwise(1)
    total = each.select("head", "salt", word(F.col("e")).alias("tail"), f.alias("f")).groupBy("head", "salt", "tail").agg(F.sum("f").alias("f"))
    total = total.where((F.col("f") >= least) | F.startswith("head", F.lit("\n")))
    end = F.instr("head", F.lit("\n"))
    first = F.substr("head", F.lit(1), end - 1)
    phrase = F.when(F.col("tail") == "", first).otherwise(F.concat(first, F.lit(" "), "tail"))
    kept = total.select(F.substr("head", end + 1).alias("lang"), phrase.alias("phrase"), "f")
    return kept.select("lang", F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " "))).alias("size"), "phrase", "f")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, subsumed: int = SUBSUMED, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's `top` phrases of 2 to LONGEST words by score, then a, then phrase.

    a is the phrase's count, n the lang's words; of all cuts in two, l and r are the counts of the parts of the one
    with the smallest score floor(SCALE a a / (l r)), the first of equals. A phrase with fewer than `least`
    occurrences is none; one that lies in a longer phrase with at least `subsumed` percent of its count is left out.

    A null lang counts as "und", a null or empty text has no words; repeated rows count each time; ids and other
    columns play no part. Numbers are exact: products are decimals of 38 digits.
    """
    counted = materialize(phrase_counts(docs, least, text_col, lang_col), "phrases")
    phrases = counted.where("size >= 2")
    first, rest = _words(F.col("phrase"), F.col("cut")), _words(F.col("phrase"), F.col("cut") - F.col("size"))
    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select("lang", F.col("phrase"), F.col("f").alias("a"), "cut", first.alias("first"), rest.alias("rest"))
    parts = counted.where("size >= 1")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    long = "cast({} as decimal(19,0))".format
    score = F.expr(f"cast({SCALE} as decimal(38,0)) * {long('a')} * {long('a')} div ({long('l')} * {long('r')})")
    best = cuts.withColumn("x", F.struct(score.alias("score"), "cut", "l", "r")).groupBy("lang", "phrase", "a").agg(F.min("x").alias("x"))
    # the ends of suffix links and transitions, from the longer phrase to the ones inside it, level by level
    inner = phrases.where("size > 2").select("lang", "phrase", "size", "f", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("k"))
    inner = inner.withColumn("skip", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("k"))))
    held = _words(_words(F.col("phrase"), F.col("skip") + F.col("k")), -F.col("k"))
    longer = inner.select("lang", held.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(100 * F.coalesce("longer", F.lit(0)) < subsumed * F.col("a"))
    rows = kept.select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    # a language's rows are ranked in SALTS tasks, whose first `top` meet in one
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    head = salted.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = head.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    words = counted.where("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
