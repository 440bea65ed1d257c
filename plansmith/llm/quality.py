"""Quality rules: language-specific bands of n-gram perplexity, beside a few rules on repetition and length.

The model of each language is a modified Kneser-Ney bigram model of words, counted over every occurrence in all
documents. A word counts as unseen where it stands: its own occurrence is left out of the counts that score it, so a
document's perplexity tells how well the other occurrences foresee it. N-grams seen once then weigh nothing, and the
stored model holds those of two and more without any loss.

Tasks cut their documents into blocks and sort each block's distinct n-grams; only these sorted lists are shuffled, to
slices of the n-gram space. A slice merges its lists into one sorted hash array with counts, stores it, and answers
each block with the counts of its n-grams; in the same way slices of the vocabulary add up what belongs to a word and
answer the blocks' words. So every n-gram is looked up where its array lies, no scoring task reads the model,
and texts never move. Bands come from a histogram of all documents' scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from plansmith.llm.common import fresh_path, remove, settled, stored, table
from plansmith.llm.shingles import mix64, windows
from plansmith.llm.token_files import _filesystem
from plansmith.llm.workers import forgets, tidied, tidied_group
from plansmith.session import ship

#: Words of a block: its n-grams are sorted and answered together.
BLOCK = 4_000_000
#: Characters of all texts for each slice of the n-gram space, so that a slice stays small however much there is.
SLICE = 16_000_000
#: Characters of texts whose words are hashed together.
TOGETHER = 1 << 20
#: Words that a worker remembers with their hashes.
CACHED_WORDS = 500_000
#: N-grams whose probabilities are worked out together.
AT_ONCE = 1 << 18
#: Bands of up to so many languages are broadcast; more meet by shuffle.
FEW_LANGUAGES = 10_000
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rules:
    """Scores are mean bits a word. A text is kept from below times its language's median score up to the median plus above times (upper quartile - median, floor bits at least).

    A language's own median and quartile weigh texts / (texts + lean), those of all languages together the rest.
    """

    min_words: int = 20
    repeat_percent: int = 30
    window: int = 8
    below: float = 0.1
    above: float = 5.0
    floor: float = 0.05
    lean: int = 20


# ---- words and blocks ----

_HASHES: dict[bytes, int] = {}
forgets(_HASHES.clear)


def _hashed(texts: list[list[bytes]]) -> list[np.ndarray]:
    """64-bit hashes of each text's words."""
    if len(_HASHES) > CACHED_WORDS:
        _HASHES.clear()
    every = [w for t in texts for w in t]
    new = {w: xxh3_64_intdigest(w) for w in set(every).difference(_HASHES)}
    found = _HASHES | new if len(new) > CACHED_WORDS else _HASHES
    _HASHES.update(new if found is _HASHES else ())
    flat = np.fromiter(map(found.__getitem__, every), np.uint64, len(every))
    return np.split(flat, np.cumsum([len(t) for t in texts])[:-1]) if texts else []


def bigrams(hashes: np.ndarray) -> np.ndarray:
    """For each word, 32 bits of the word before it (0 at the beginning) and 32 of its own."""
    own = hashes >> np.uint64(32)
    return np.concatenate([np.zeros(1, np.uint64), own[:-1]])[: len(own)] << np.uint64(32) | own


def _parts(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[list[tuple], list[str]]]:
    """Some rows without their text, and the texts."""
    for b in batches:
        others = [b.column(i).to_pylist() for i in range(b.num_columns) if i != text]
        rows, texts, size = [], [], 0
        for row, t in zip(zip(*others, strict=True), b.column(text), strict=True):
            rows.append(row), texts.append(t.as_py() or "")
            size += len(texts[-1]) + 256
            if size > TOGETHER:
                yield rows, texts
                rows, texts, size = [], [], 0
        if rows:
            yield rows, texts


def blocks(batches: Iterator[pa.RecordBatch], most: int, rules: Rules | None = None) -> Iterator[list[tuple]]:
    """Lists of (lang, n-grams, other columns, base counts if there are rules) of about most words. Columns: lang, text, others."""
    docs, n = [], 0
    for rows, texts in _parts(batches, 1):
        for (lang, *rest), text, hashes in zip(rows, texts, _hashed([t.encode().split() for t in texts]), strict=True):
            docs.append((lang, bigrams(hashes), rest, rules and (len(hashes), *base_counts(text), repeated_words(hashes, rules.window))))
            n += len(hashes)
            if n >= most:
                yield docs
                docs, n = [], 0
    if docs:
        yield docs


# ---- sorted arrays as bytes ----


def _zip(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def ints(x: np.ndarray) -> bytes:
    """Numbers from 0 on, their lowest bytes first, then the next ones, compressed."""
    x = x.astype(np.min_scalar_type(int(x.max(initial=0))))
    return bytes([x.itemsize]) + len(x).to_bytes(8, "little") + _zip(x.view(np.uint8).reshape(-1, x.itemsize).T)


def unints(b: bytes) -> np.ndarray:
    size, n = b[0], int.from_bytes(b[1:9], "little")
    planes = np.frombuffer(pa.decompress(b[9:], n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(f"<u{size}").reshape(n).astype(np.int64)


def _sized(*parts: bytes) -> bytes:
    return b"".join(len(b).to_bytes(4, "little") + b for b in parts)


def _unsized(b: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(b):
        n = int.from_bytes(b[at : at + 4], "little")
        out.append(b[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def pack(x: np.ndarray) -> bytes:
    """Sorted distinct uint64: their low bytes as they are, the distances of what is above them compressed."""
    low = 0 if not len(x) else min(7, max(0, (int(x[-1]) // len(x)).bit_length() // 8))
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :low]).tobytes()
    return bytes([low]) + len(x).to_bytes(8, "little") + raw + ints(np.diff(x >> np.uint64(8 * low), prepend=np.uint64(0)))


def unpack(b: bytes) -> np.ndarray:
    low, n = b[0], int.from_bytes(b[1:9], "little")
    out = np.zeros((n, 8), np.uint8)
    out[:, :low] = np.frombuffer(b, np.uint8, n * low, 9).reshape(n, low)
    return out.view(np.uint64).reshape(n) | np.cumsum(unints(b[9 + n * low :])).astype(np.uint64) << np.uint64(8 * low)


@dataclass(frozen=True)
class Grid:
    """Slices of n-grams by near bits of each of both words and then extra bits of both together, so that neither a frequent word nor a frequent pair fills one; slices of words by wide bits. A slice's members agree in the near bits, which aren't stored. block: words of a block."""

    near: int
    extra: int
    wide: int
    block: int = BLOCK

    @classmethod
    def of(cls, chars: int) -> "Grid":
        bits = max(0, -(-chars // SLICE) - 1).bit_length()
        near = min(4, (bits + 1) // 2)
        return cls(near, max(0, bits - 8), bits // 2 + 1, BLOCK)

    def slices(self, grams: np.ndarray) -> np.ndarray:
        mask, near = np.uint64((1 << self.near) - 1), np.uint64(self.near)
        at = (grams >> np.uint64(32) & mask) << near | grams & mask
        if self.extra:
            at = at << np.uint64(self.extra) | mix64(grams) >> np.uint64(64 - self.extra)
        return at.astype(np.int64)

    def word_slices(self, words: np.ndarray) -> np.ndarray:
        return (words & np.uint64((1 << self.wide) - 1)).astype(np.int64)

    def pack(self, grams: np.ndarray) -> bytes:
        """Sorted distinct n-grams: the first words, how often each stands, the second words, and which of them each n-gram has."""
        near = np.uint64(self.near)
        u, (v, which) = grams >> np.uint64(32) + near, np.unique((grams & np.uint64(0xFFFFFFFF)) >> near, return_inverse=True)
        start = np.flatnonzero(np.diff(u, prepend=~u[:1]))
        return _sized(pack(u[start]), ints(np.diff(start, append=len(u))), pack(v), ints(which))

    def unpack(self, b: bytes, at: int) -> np.ndarray:
        first, often, second, which = _unsized(b)
        near, part = np.uint64(self.near), at >> self.extra
        u = np.repeat(unpack(first), unints(often)) << near | np.uint64(part >> self.near)
        v = unpack(second)[unints(which)] << near | np.uint64(part & (1 << self.near) - 1)
        return u << np.uint64(32) | v

    def pack_words(self, words: np.ndarray) -> bytes:
        return pack(words >> np.uint64(self.wide))

    def unpack_words(self, b: bytes, at: int) -> np.ndarray:
        return unpack(b) << np.uint64(self.wide) | np.uint64(at)


def _groups(at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, ascending places) of each value."""
    order = np.argsort(at, kind="stable")
    edge = np.flatnonzero(np.diff(at[order])) + 1
    for part in np.split(order, edge) if len(order) else ():
        yield int(at[part[0]]), part


def block_name(grams: np.ndarray) -> int:
    """A block goes by what it asks for."""
    return int(np.array([xxh3_64_intdigest(np.ascontiguousarray(grams))], np.uint64).view(np.int64)[0])


def _vocabulary(grams: np.ndarray) -> np.ndarray:
    return np.unique(np.concatenate([grams >> np.uint64(32), grams & np.uint64(0xFFFFFFFF)]))


# ---- counting and looking up ----

ROWS = "kind string, slot bigint, lang string, block bigint, a binary, b binary"


def _table(rows: list[tuple]) -> pa.Table:
    kinds = pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()
    names = [x.split()[0] for x in ROWS.split(", ")]
    return pa.table([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names=names)


def asked(df: DataFrame, grid: Grid) -> DataFrame:
    """df (lang, t) to lists of distinct n-grams with counts ('grams') and of distinct words ('asked'), one for each block, language and slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs in blocks(batches, grid.block):
            by: dict[str, list] = {}
            for lang, found, _, _ in docs:
                by.setdefault(lang, []).append(found)
            del found
            docs.clear()
            for lang in list(by):
                grams, counts = np.unique(np.concatenate(by.pop(lang)), return_counts=True)
                if not len(grams):
                    continue
                name, words = block_name(grams), _vocabulary(grams)
                rows = [("grams", at, lang, name, grid.pack(grams[i]), ints(counts[i])) for at, i in _groups(grid.slices(grams))]
                rows += [("asked", at, lang, name, grid.pack_words(words[i]), None) for at, i in _groups(grid.word_slices(words))]
                yield from _table(rows).to_batches()

    return df.select("lang", "t").mapInArrow(tidied(run), ROWS)


def _merged(rows: list[dict], unpacked: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct members of all lists, and where each list's members are among them."""
    every, place = np.unique(np.concatenate(unpacked), return_inverse=True)
    return every, np.split(place, np.cumsum([len(x) for x in unpacked])[:-1])


def _by_language(found: pa.Table) -> Iterator[tuple[str, list[dict]]]:
    by: dict[str, list[dict]] = {}
    for row in found.to_pylist():
        by.setdefault(row["lang"], []).append(row)
    yield from by.items()


def count_grams(rows: DataFrame, grid: Grid) -> DataFrame:
    """Slices of asked() to: 'model' (sorted n-grams seen twice or more, counts), 'found' (counts in the order of a block's list), 'context' and 'left' (partial facts of words), 'sizes' (n-grams seen once to four times, and all). 'asked' goes through."""

    def run(found: pa.Table) -> pa.Table:
        out = []
        for lang, lists in _by_language(found):
            if lists[0]["kind"] == "asked":
                out += [tuple(x.values()) for x in lists]
                continue
            at = lists[0]["slot"]
            grams, places = _merged(lists, [grid.unpack(x["a"], at) for x in lists])
            total = np.bincount(np.concatenate(places), np.concatenate([unints(x["b"]) for x in lists])).astype(np.int64)
            out += [("found", at, lang, x["block"], None, ints(total[i])) for x, i in zip(lists, places, strict=True)]
            again = total > 1
            out.append(("model", at, lang, None, grid.pack(grams[again]), ints(total[again])))
            first = grams >> np.uint64(32)
            start = np.flatnonzero(np.diff(first, prepend=first[0] + np.uint64(1)))
            facts = np.stack([np.add.reduceat(x, start) for x in (total, total == 1, total == 2, total > 2)]).astype(np.int64)
            for w, i in _groups(grid.word_slices(first[start])):
                out.append(("context", w, lang, None, grid.pack_words(first[start][i]), ints(facts[:, i].ravel())))
            words, left = np.unique(grams & np.uint64(0xFFFFFFFF), return_counts=True)
            for w, i in _groups(grid.word_slices(words)):
                out.append(("left", w, lang, None, grid.pack_words(words[i]), ints(left[i])))
            out.append(("sizes", at, lang, None, None, ints(_sizes(total))))
        return _table(out)

    part = F.when(F.col("kind") == "grams", F.col("slot")).otherwise(-1 - F.col("slot"))
    return rows.groupBy(part).applyInArrow(tidied_group(run), ROWS)


def _sizes(counts: np.ndarray) -> np.ndarray:
    """How many are 1, 2, 3 and 4, and how many there are."""
    return np.append(np.bincount(np.minimum(counts, 5), minlength=6)[1:5], len(counts))


def count_words(rows: DataFrame, grid: Grid) -> DataFrame:
    """'asked', 'context' and 'left' of a slice of words to: 'words' (sorted words and their facts), 'known' (facts in the order of a block's words), 'sizes' (words with one to four left neighbours, and all).

    Facts: occurrences as a context, followers seen once, twice and more often, and left neighbours.
    """

    def run(found: pa.Table) -> pa.Table:
        out = []
        for lang, lists in _by_language(found):
            at = lists[0]["slot"]
            words, places = _merged(lists, [grid.unpack_words(x["a"], at) for x in lists])
            facts = np.zeros((5, len(words)), np.int64)
            for x, i in zip(lists, places, strict=True):
                if x["kind"] == "context":
                    facts[:4, i] += unints(x["b"]).reshape(4, -1)
                elif x["kind"] == "left":
                    facts[4, i] += unints(x["b"])
            out.append(("words", at, lang, None, grid.pack_words(words), ints(facts.ravel())))
            out += [("known", at, lang, x["block"], None, _sized(*map(ints, facts[:, i]))) for x, i in zip(lists, places, strict=True) if x["kind"] == "asked"]
            out.append(("sizes", at, lang, None, None, ints(_sizes(facts[4][facts[4] > 0]))))
        return _table(out)

    return rows.groupBy("slot").applyInArrow(tidied_group(run), ROWS)


# ---- the model ----


def discounts(sizes: np.ndarray) -> np.ndarray:
    """What is taken off counts 0, 1, 2 and 3 or more, from how many n-grams there are of counts 1 to 4."""
    n = [0.0, *sizes[:4].tolist()]
    if not all(n[1:]):
        return np.array([0, 0.5, 1.0, 1.5])
    y = n[1] / (n[1] + 2 * n[2])
    return np.array([0] + [max(0.1 * i, min(0.95 * i, i - (i + 1) * y * n[i + 1] / n[i])) for i in (1, 2, 3)])


@dataclass(frozen=True)
class Language:
    """sizes of its n-grams by occurrences, and of its words by left neighbours."""

    grams: np.ndarray
    words: np.ndarray

    def bits(self, count: np.ndarray, context: np.ndarray, left: np.ndarray) -> np.ndarray:
        """-log2 of the probability of an occurrence of each n-gram with that occurrence left out of all counts. context: rows of facts of the word before."""
        high, low = discounts(self.grams), discounts(self.words)
        cut = lambda d, x: d[np.minimum(x, 3)]
        once = (count == 1).astype(np.int64)
        types, vocabulary = self.grams[4] - once, self.words[4] + 1
        spare = low[1] * self.words[0] + low[2] * self.words[1] + low[3] * (self.words[4] - self.words[0] - self.words[1])
        a = left - once
        n = np.maximum(types, 1)
        short = np.where(types > 0, (a - cut(low, a)) / n + (spare - cut(low, left) + cut(low, a)) / n / vocabulary, 1 / vocabulary)
        c, every = count - 1, context[0] - 1
        free = high[1] * context[1] + high[2] * context[2] + high[3] * context[3] - cut(high, count) + cut(high, c)
        n = np.maximum(every, 1)
        return -np.log2(np.where(every > 0, (c - cut(high, c)) / n + free / n * short, short))


class Answers:
    """Counts and facts for a block's n-grams and words: from the block's own file, or, where the input was cut otherwise when it was counted, from the model's arrays."""

    def __init__(self, path: str, grid: Grid) -> None:
        self.fs, self.at = _filesystem(path)
        self.grid = grid

    def _files(self, folder: str) -> list[str]:
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.at}/{folder}", allow_not_found=True))
        return sorted(x.path for x in found if x.base_name.endswith(".parquet"))

    def _rows(self, folder: str, lang: str) -> Iterator[dict]:
        for name in self._files(folder):
            with self.fs.open_input_file(name) as f:
                for b in pq.ParquetFile(f).iter_batches(batch_size=16):
                    yield from (x for x in b.to_pylist() if x["lang"] == lang)

    def of(self, lang: str, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of grams, the words in them, and the words' facts."""
        words = _vocabulary(grams)
        counts, facts = np.ones(len(grams), np.int64), np.zeros((5, len(words)), np.int64)
        places, word_places = dict(_groups(self.grid.slices(grams))), dict(_groups(self.grid.word_slices(words)))
        folder = f"answers/block={block_name(grams)}"
        if self._files(folder):
            for x in self._rows(folder, lang):
                if x["kind"] == "found":
                    counts[places[x["slot"]]] = unints(x["b"])
                else:
                    facts[:, word_places[x["slot"]]] = [unints(y) for y in _unsized(x["b"])]
            return counts, words, facts
        for x in self._rows("grams/kind=model", lang):
            if (i := places.get(x["slot"])) is not None:
                at, ok = _find(self.grid.unpack(x["a"], x["slot"]), grams[i])
                counts[i[ok]] = unints(x["b"])[at[ok]]
        for x in self._rows("words/kind=words", lang):
            if (i := word_places.get(x["slot"])) is not None:
                at, ok = _find(self.grid.unpack_words(x["a"], x["slot"]), words[i])
                facts[:, i[ok]] = unints(x["b"]).reshape(5, -1)[:, at[ok]]
        return counts, words, facts


def _find(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted in a sorted array, and whether they are there."""
    if not len(known):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


def build_model(rows: DataFrame, path: str) -> tuple[Grid, dict[str, Language]]:
    """Counts rows (lang, t) into path: grams/kind=model and words/kind=words are the model, answers/block=... what each block asked for. The driver gets a row a language."""
    spark = rows.sparkSession
    grid = Grid.of(rows.agg(F.sum(F.length("t"))).first()[0] or 0)
    read = lambda x: spark.read.schema(ROWS).parquet(f"{path}/{x}")
    with settled(spark):
        count_grams(asked(rows, grid), grid).write.partitionBy("kind").parquet(f"{path}/grams")
        count_words(read("grams").filter(F.col("kind").isin("asked", "context", "left")), grid).write.partitionBy("kind").parquet(f"{path}/words")
        answers = read("grams").filter("kind = 'found'").unionByName(read("words").filter("kind = 'known'"))
        answers.select("kind", "slot", "lang", "block", "b").repartition("block").write.partitionBy("block").parquet(f"{path}/answers")
    for gone in ("asked", "context", "left", "found"):
        remove(spark, f"{path}/grams/kind={gone}")
    remove(spark, f"{path}/words/kind=known")
    sizes: dict[str, dict[str, np.ndarray]] = {}
    for which in ("grams", "words"):
        for lang, b in read(which).filter("kind = 'sizes'").groupBy("lang").agg(F.collect_list("b")).collect():
            sizes.setdefault(lang, {})[which] = sum(unints(x) for x in b)
    return grid, {lang: Language(**x) for lang, x in sizes.items()}


# ---- scores and verdicts ----


def repeated_words(hashes: np.ndarray, window: int) -> int:
    """Words that lie in windows found twice or more."""
    if len(hashes) <= window:
        return 0
    found = windows(hashes, window)
    order = np.sort(found)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    starts = np.flatnonzero(np.isin(found, again))
    edge = np.zeros(len(hashes) + 1, np.int64)
    edge[starts] += 1
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int]:
    """Code points of words, symbols, and lines with a word that an earlier line equals."""
    seen: set[str] = set()
    again = 0
    if "\n" in text:
        for line in text.split("\n"):
            if line in seen:
                again += 1
            elif line.strip(BLANKS):
                seen.add(line)
    return len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), again


SCORES = "id bigint, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, bits double"


def scored(df: DataFrame, path: str, grid: Grid, languages: dict[str, Language], rules: Rules) -> DataFrame:
    """df (id, lang, t) with base counts and mean bits a word under the model in path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = Answers(path, grid)
        for docs in blocks(batches, grid.block, rules):
            by: dict[str, tuple[list[int], list[np.ndarray]]] = {}
            for i, (lang, found, _, _) in enumerate(docs):
                mine, grams = by.setdefault(lang, ([], []))
                mine.append(i), grams.append(found)
            rows = [(lang, rest, base) for lang, _, rest, base in docs]
            mean: list[float | None] = [None] * len(docs)
            del found, grams
            docs.clear()
            for lang in list(by):
                mine, found = by.pop(lang)
                sizes = np.array([len(x) for x in found])
                found = np.concatenate(found)
                grams, place = np.unique(found, return_inverse=True)
                del found
                if not len(grams):
                    continue
                counts, words, facts = answers.of(lang, grams)
                bits = np.empty(len(grams))
                for at in range(0, len(grams), AT_ONCE):
                    some = slice(at, at + AT_ONCE)
                    before, own = (np.searchsorted(words, x) for x in (grams[some] >> np.uint64(32), grams[some] & np.uint64(0xFFFFFFFF)))
                    bits[some] = languages[lang].bits(counts[some], facts[:, before], facts[4][own])
                bits = np.cumsum(np.append(0.0, bits[place]))
                ends = np.cumsum(sizes)
                for i, n, x in zip(mine, sizes.tolist(), (bits[ends] - bits[ends - sizes]).tolist(), strict=True):
                    mean[i] = x / n if n else None
            columns = [[rest[0] for _, rest, _ in rows], [lang for lang, _, _ in rows], *zip(*(base for _, _, base in rows)), mean]
            kinds = [pa.int64(), pa.string(), *[pa.int64()] * 5, pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in SCORES.split(", ")])

    return df.select("lang", "t", "id").mapInArrow(tidied(run), SCORES)


def _failed(rules: Rules) -> Column:
    return (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words"))


def bands(scores: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(lang, low, high) in bits a word, for every language of scores.

    From median and upper quartile of a histogram in thousandths of the scores of texts that pass the base rules; texts of
    equal length and score, as copies are, count once.
    """
    once = scores.filter(~_failed(rules)).select("lang", "n_words", F.round(F.col("bits") * 1000).cast("long").alias("bin")).distinct()
    fine = once.groupBy("lang", "bin").agg(F.count("*").alias("n"))
    at = F.expr("percentile(bin, array(0.5, 0.75), n)").alias("q")
    own = fine.groupBy("lang").agg(at, F.sum("n").alias("texts"))
    pooled = fine.groupBy("bin").agg(F.sum("n").alias("n")).agg(at).select(F.col("q").alias("all_q"))
    share = F.coalesce(F.col("texts") / (F.col("texts") + rules.lean), F.lit(0.0))
    mix = lambda i: F.coalesce(share * F.col("q")[i], F.lit(0.0)) + (1 - share) * F.col("all_q")[i]
    # One row meets a row for each language.
    out = scores.select("lang").distinct().join(own, "lang", "left").crossJoin(F.broadcast(pooled))
    out = out.select("lang", (mix(0) / 1000).alias("mid"), (mix(1) / 1000).alias("upper"))
    spread = F.greatest(F.col("upper") - F.col("mid"), F.lit(rules.floor))
    return out.select("lang", (rules.below * F.col("mid")).alias("low"), (F.col("mid") + rules.above * spread).alias("high"))


def assess(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, perplexity, low, high) for every row of df.

    Perplexity is 2 to the mean bits a word; low and high bound it, ends included. Null or blank texts have no words,
    perplexity null and fail the base rules. A null language is a language of its own, together with the empty name.
    Repeated rows count as often as they come. Languages with few texts lean on all languages' bands; where no text
    passes the base rules, low and high are null. Empty input: empty result. Only the three named columns are read, twice.
    """
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")).alias("lang"), F.col(f"`{text_col}`").alias("t"))
    path = fresh_path(spark, "ngrams")
    with settled(spark):
        grid, languages = build_model(rows, path)
        scores = stored(scored(rows, path, grid, languages, rules), "scores")
    remove(spark, path)
    limits = stored(bands(scores, rules), "bands")
    few = limits.count() <= FEW_LANGUAGES
    out = scores.join(F.broadcast(limits) if few else limits.hint("merge"), "lang", "left")
    failed = _failed(rules)
    power = lambda x, name: F.pow(F.lit(2.0), x).alias(name)
    return out.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & F.col("bits").between(F.col("low"), F.col("high"))).alias("kept"), power("bits", "perplexity"), power("low", "low"), power("high", "high"),
    )


def keep_good(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """df's rows whose id is kept; of a repeated id all rows stay if one is kept."""
    kept = assess(df, id_col, text_col, lang_col, rules).filter("kept").select(F.col(id_col).alias("__kept")).distinct()
    return df.join(kept, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__kept")), "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents"))
