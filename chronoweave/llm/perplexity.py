"""Quality rules by N-gram perplexity.

Character 5-grams of all texts are counted by Spark, language by language.  Discounts and backoff
weights of modified Kneser-Ney smoothing come from those counts by aggregations and equi joins; no
count is cut off and no gram shares its place with another.  For scoring, every worker holds the
probabilities of a bounded number of the most frequent grams and adds them up where the text is; the
other grams of a text meet theirs by an equi join on the whole gram, so texts are neither stored nor
moved, and the model stays spread over Spark's partitions and grows with the corpus.  No text is
scored by its own counts: texts are dealt into folds by their hash, so copies stay together, and each
fold has a model of all the others.  Each language gets a lower and an upper bound on the log
perplexity from the spread of its own documents.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, map_rows, row_key, row_number_base, stored, texts_of

ORDER = 5
CHAR_BITS = 12  # low bits of a character in a packed gram; five fit into a long
HIGH_BITS = 9  # the other bits of a code point, packed into a second long
# Characters of the texts that are counted or scored together; bounds a worker's memory, not the results.
CHUNK = 1 << 20
# Most frequent grams that every worker holds; bounds what is broadcast, not the results.
COMMON = 1 << 18
# Logs are added as whole multiples of 1 / UNIT, so their sum is the same in any order.
UNIT = 1 << 40
SLOT_BITS = 24  # of HashArrays
FOLDS = 2
# A language's bounds: its median plus and minus so many median absolute deviations.
BAND = 8.0
_MASK = (1 << CHAR_BITS) - 1
_SYMBOLS = "#*$%&|<>"
_GRAM, _CONTEXT = 1, 2


# -- grams ------------------------------------------------------------------------------------


def points(text: str) -> np.ndarray:
    """Code points of the lower-cased text, white space as one blank, digits as one."""
    out = np.frombuffer(" ".join(text.lower().split()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where((out >= 48) & (out <= 57), np.uint32(48), out).astype(np.int64)


def characters(text: str) -> np.ndarray:
    """The low CHAR_BITS of the code points."""
    return points(text) & _MASK


def wide_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed 5-gram that ends at each character, as low and high bits, and the number of characters
    of each text.

    A text begins behind four boundary codes, which are 0.
    """
    codes = [points(t) for t in texts]
    sizes = np.array([len(c) for c in codes], dtype=np.int64)
    gap = np.zeros(ORDER - 1, np.int64)
    line = np.concatenate([x for c in codes for x in (gap, c)] or [gap])
    real = np.ones(len(line) - ORDER + 1, dtype=bool)
    ends = np.cumsum(sizes + ORDER - 1) - (ORDER - 1)
    for i in range(ORDER - 1):
        real[(ends[:-1] + i)] = False

    def packed(part: np.ndarray, bits: int) -> np.ndarray:
        key = part[ORDER - 1 :].copy()
        for back in range(1, ORDER):
            key |= part[ORDER - 1 - back : len(part) - back] << (bits * back)
        return key[real]

    key, high = packed(line & _MASK, CHAR_BITS), line >> CHAR_BITS
    return key, packed(high, HIGH_BITS) if high.any() else np.zeros(len(key), np.int64), sizes


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Low bits of the packed 5-grams, and the number of characters of each text."""
    return wide_grams(texts)[::2]


def sort_order(key: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.lexsort((key, high)) if high.any() else np.argsort(key, kind="stable")


def distinct(key: np.ndarray, high: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different grams in order, and the sum of ``counts`` (without them, the number) of each."""
    if not len(key):
        return key, high, key
    if counts is None and not high.any():
        key, counts = np.unique(key, return_counts=True)
        return key, np.zeros(len(key), np.int64), counts
    order = sort_order(key, high)
    key, high = key[order], high[order]
    first = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (high[1:] != high[:-1])) + 1])
    counts = np.add.reduceat(np.ones(len(key), np.int64) if counts is None else counts[order], first)
    return key[first], high[first], counts


def by_language(langs: list, texts: list[str]) -> Iterator[tuple]:
    """Rows of one language (or other key) in chunks of about a million characters."""
    rows: dict = {}
    held: dict = {}
    for i, (lang, text) in enumerate(zip(langs, texts, strict=True)):
        lang = lang or ""
        rows.setdefault(lang, []).append(i)
        held[lang] = held.get(lang, 0) + len(text)
        if held[lang] >= CHUNK:
            yield lang, rows.pop(lang)
            held[lang] = 0
    yield from rows.items()


def fold(folds: int) -> Column:
    """Fold of a row by its text."""
    return F.pmod(row_key(F.col("text")), F.lit(folds)).cast("int")


def count(docs: DataFrame, folds: int = 1) -> DataFrame:
    """(lang, high, key, c0, c1 ...): how often each 5-gram occurs in the texts of a language that
    are in another fold than 0, 1 ...; in all texts if there is one fold.  No language is ''.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

        def merged(lang: tuple[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            parts = sums.pop(lang)
            return parts[0] if len(parts) == 1 else distinct(*(np.concatenate(p) for p in zip(*parts, strict=True)))

        def rows(lang: tuple[str, int], *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(columns[0]), 100_000):
                key, high, c = (x[at : at + 100_000] for x in columns)
                made = [pa.array([lang[0]] * len(key)), pa.array(np.full(len(key), lang[1], np.int32)), pa.array(high), pa.array(key), pa.array(c)]
                yield pa.RecordBatch.from_arrays(made, ["lang", "fold", "high", "key", "c"])

        for batch in batches:
            texts = texts_of(batch.column(2))
            langs = [(lang or "", f) for lang, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            for lang, chosen in by_language(langs, texts):
                found = distinct(*wide_grams([texts[i] for i in chosen])[:2])
                if not len(found[0]):
                    continue
                sums.setdefault(lang, []).append(found)
                if len(sums[lang]) >= 8:
                    sums[lang] = [merged(lang)]
                    if len(sums[lang][0][0]) > 2_000_000:
                        yield from rows(lang, *sums.pop(lang)[0])
        for lang in list(sums):
            yield from rows(lang, *merged(lang))

    partial = in_arrow(docs.select("lang", fold(folds).alias("fold"), "text"), run, "lang string, fold int, high long, key long, c long")
    other = [F.col("fold") != i if folds > 1 else F.lit(True) for i in range(folds)]
    return partial.groupBy("lang", "high", "key").agg(*[F.sum(F.when(x, F.col("c")).otherwise(0)).alias(f"c{i}") for i, x in enumerate(other)])


# -- modified Kneser-Ney ----------------------------------------------------------------------


def discounts(counts: DataFrame, models: range) -> DataFrame:
    """(lang, d1_i, d2_i, d3_i) for each model i from how many grams occur once to four times in it.

    Where such a number is zero the estimate isn't defined and 0.5, 1 and 1.5 stand in.
    """
    n = [F.sum((F.col(f"c{m}") == i).cast("long")).cast("double").alias(f"n{i}_{m}") for m in models for i in range(1, 5)]
    out = []
    for m in models:
        n1, n2, n3, n4 = (F.col(f"n{i}_{m}") for i in range(1, 5))
        fine = (n1 > 0) & (n2 > 0) & (n3 > 0) & (n4 > 0)
        bound = lambda v, top, other: F.when(fine, F.least(F.greatest(v, F.lit(0.0)), F.lit(top))).otherwise(F.lit(other))  # noqa: B023, E731
        y = F.try_divide(n1, n1 + 2 * n2)
        out += [bound(1 - 2 * y * F.try_divide(n2, n1), 1.0, 0.5).alias(f"d1_{m}"), bound(2 - 3 * y * F.try_divide(n3, n2), 2.0, 1.0).alias(f"d2_{m}")]
        out += [bound(3 - 4 * y * F.try_divide(n4, n3), 3.0, 1.5).alias(f"d3_{m}")]
    return counts.groupBy("lang").agg(*n).select("lang", *out)


def discount(c: Column, m: int) -> Column:
    return F.when(c == 1, F.col(f"d1_{m}")).when(c == 2, F.col(f"d2_{m}")).otherwise(F.col(f"d3_{m}"))


def orders(counts: DataFrame, whole: bool = False) -> list[DataFrame]:
    """For each order n (lang, high, key, p0, p1 ...): every n-gram's interpolated probability in each
    model; ``whole`` adds n, the counts and the backoff weights of the first n - 1 characters, else the
    highest order has ``seen``, the sum of the counts.

    ``counts`` has a column c0, c1 ... for each model.  A gram that a model hasn't seen counts 0
    there and gets what backing off gives.  Below the highest order a gram counts by how many
    characters it follows.
    """
    models = range(sum(c[0] == "c" for c in counts.columns))
    tables = {ORDER: stored(counts, "grams")}

    def tail(n: int) -> list[Column]:
        """Key of the last n characters."""
        return [F.col(c).bitwiseAND(F.lit((1 << (bits * n)) - 1)) for c, bits in (("high", HIGH_BITS), ("key", CHAR_BITS))]

    for n in range(ORDER - 1, 0, -1):
        high, key = tail(n)
        cut = tables[n + 1].select("lang", high.alias("high"), key.alias("key"), *[(F.col(f"c{m}") > 0).cast("long").alias(f"c{m}") for m in models])
        tables[n] = stored(cut.groupBy("lang", "high", "key").agg(*[F.sum(f"c{m}").alias(f"c{m}") for m in models]), f"grams{n}")
    # a language has one row here; stored, so that its size is known and decides on a broadcast
    size = stored(tables[1].groupBy("lang").agg((F.count("*") + 1).alias("v")), "sizes")
    out: list[DataFrame] = []
    for n in range(1, ORDER + 1):
        mine = tables[n].withColumn("chigh", F.shiftright("high", HIGH_BITS)).withColumn("ctx", F.shiftright("key", CHAR_BITS))
        d = stored(discounts(tables[n], models), "discounts")
        sums = []
        for m in models:
            c = F.col(f"c{m}")
            sums += [F.sum(c).alias(f"total{m}"), *[F.sum(x.cast("long")).alias(f"n{i}_{m}") for i, x in ((1, c == 1), (2, c == 2), (3, c > 2))]]
        ctx = mine.groupBy("lang", "chigh", "ctx").agg(*sums).join(d, "lang")
        for m in models:
            freed = sum(F.col(f"d{i}_{m}") * F.col(f"n{i}_{m}") for i in (1, 2, 3))
            # a context that a model hasn't seen leaves all to the shorter one
            ctx = ctx.withColumn(f"gamma{m}", F.greatest(F.coalesce(F.try_divide(freed, F.col(f"total{m}")), F.lit(1.0)), F.lit(1e-12)))
        rows = mine.join(ctx, ["lang", "chigh", "ctx"])
        if n == 1:
            rows = rows.join(size, "lang").select("*", *[(1 / F.col("v")).alias(f"below{m}") for m in models])
        else:
            high, key = tail(n - 1)
            lower = out[-1].select("lang", F.col("high").alias("thigh"), F.col("key").alias("tail"), *[F.col(f"p{m}").alias(f"below{m}") for m in models])
            rows = rows.withColumn("thigh", high).withColumn("tail", key).join(lower, ["lang", "thigh", "tail"])
        p = []
        for m in models:
            c = F.col(f"c{m}")
            own = F.coalesce(F.try_divide(F.greatest(c - discount(c, m), F.lit(0.0)), F.col(f"total{m}")), F.lit(0.0))
            p.append((own + F.col(f"gamma{m}") * F.col(f"below{m}")).alias(f"p{m}"))
        extra = [F.lit(n).alias("n"), *[F.col(f"{x}{m}") for x in ("c", "gamma") for m in models]] if whole else []
        if n == ORDER and not whole:
            extra = [sum(F.col(f"c{m}") for m in models).alias("seen")]
        out.append(stored(rows.select("lang", "high", "key", *p, *extra), f"order{n}"))
    return out


def smooth(counts: DataFrame) -> DataFrame:
    """(lang, n, key, p, gamma, weight) of every seen n-gram of one model."""
    return reduce(DataFrame.union, orders(counts, whole=True)).selectExpr("lang", "n", "key", "p0 AS p", "gamma0 AS gamma", "c0 AS weight")


# -- sorted hash arrays, for small models in one place ----------------------------------------


def slot(lang: str, kind: int, n: int, key: np.ndarray) -> np.ndarray:
    """Slot of a gram or context of n characters, below 2**SLOT_BITS."""
    salt = np.uint64(zlib.crc32(f"{lang}|{kind}|{n}".encode()) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = key.astype(np.uint64) ^ salt
    for mix in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(mix)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(64 - SLOT_BITS)).astype(np.uint32)


class HashArrays:
    """Log values by sorted slots, for looking into small models; grams of one slot share their mean
    and characters go by their low bits.  ``rules`` doesn't use it.  A missing gram backs off to
    shorter ones."""

    def __init__(self, slots: np.ndarray, logs: np.ndarray):
        self.slots, self.logs = slots, logs

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Log values, nan where a slot is empty."""
        if not len(self.slots):
            return np.full(len(wanted), np.nan, np.float32)
        at = np.minimum(np.searchsorted(self.slots, wanted), len(self.slots) - 1)
        return np.where(self.slots[at] == wanted, self.logs[at], np.float32(np.nan))

    def log_probability(self, lang: str, keys: np.ndarray) -> np.ndarray:
        """Natural log of P(last character | the ones before) of packed 5-grams."""
        out = self.find(slot(lang, _GRAM, ORDER, keys)).astype(np.float64)
        left, back = np.flatnonzero(np.isnan(out)), None
        back = np.zeros(len(left))
        for n in range(ORDER - 1, -1, -1):
            if not len(left):
                break
            context = (keys[left] >> CHAR_BITS) & ((1 << (CHAR_BITS * n)) - 1)
            back += np.nan_to_num(self.find(slot(lang, _CONTEXT, n, context)), nan=0.0)
            if n:
                p = self.find(slot(lang, _GRAM, n, keys[left] & ((1 << (CHAR_BITS * n)) - 1)))
            else:
                p = np.full(len(left), -np.log(1 << CHAR_BITS))
            done = ~np.isnan(p)
            out[left[done]] = back[done] + p[done]
            left, back = left[~done], back[~done]
        return out


def arrays(model: DataFrame) -> HashArrays:
    """Sorted hash arrays of a smoothed model; at most 2**SLOT_BITS rows come back, whatever its size."""

    def run(c: dict):
        lang, n, key = np.array(c["lang"].to_pylist(), dtype=object), c["n"].to_numpy(), c["key"].to_numpy()
        p, gamma, weight = np.log(c["p"].to_numpy()), np.log(np.maximum(c["gamma"].to_numpy(), 1e-12)), c["weight"].to_numpy().astype(np.float64)
        for code in {*zip(lang.tolist(), n.tolist(), strict=True)}:
            mine = (lang == code[0]) & (n == code[1])
            k, w = key[mine], weight[mine]
            yield {"slot": slot(code[0], _GRAM, code[1], k).astype(np.int64), "value": p[mine] * w, "weight": w}
            _, first = np.unique(k >> CHAR_BITS, return_index=True)
            ones = np.ones(len(first))
            yield {"slot": slot(code[0], _CONTEXT, code[1] - 1, k[first] >> CHAR_BITS).astype(np.int64), "value": gamma[mine][first], "weight": ones}

    rows = map_rows(model, run, "slot long, value double, weight double")
    mean = (F.sum("value") / F.sum("weight")).cast("float").alias("log")
    got = rows.groupBy("slot").agg(mean).select(F.col("slot").cast("int").alias("slot"), "log").toArrow()
    slots, logs = got["slot"].to_numpy().astype(np.uint32), got["log"].to_numpy().astype(np.float32)
    order = np.argsort(slots)
    return HashArrays(slots[order], logs[order])


# -- rules ------------------------------------------------------------------------------------

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = _WORD.findall(text)
    ids: dict[str, int] = {}
    seq = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    repeat = 0
    if len(seq) >= 4:
        base = len(ids)
        if base < 2_000_000:
            window = (seq[:-2] * base + seq[1:-1]) * base + seq[2:]
        else:  # three ids no longer fit into a long: number the pairs first
            pair = np.unique(seq[:-1] * base + seq[1:], return_inverse=True)[1]
            window = pair[:-1] * base + seq[2:]
        order = np.argsort(window, kind="stable")
        s = window[order]
        same = s[1:] == s[:-1]
        twice = np.zeros(len(window), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = np.zeros(len(seq), dtype=bool)
        for i in range(3):
            hit[i : len(seq) - 2 + i] |= twice
        repeat = int(hit.sum())
    lines, seen, dup = text.split("\n"), set(), 0
    if len(lines) > 1:
        for line in lines:
            if line in seen:
                dup += 1
            elif _WORD.search(line):
                seen.add(line)
    return len(words), sum(map(len, words)), sum(map(text.count, _SYMBOLS)), dup, repeat


class Frequent:
    """Log values of one language's frequent grams, a column for each fold, by the whole gram."""

    def __init__(self, key: np.ndarray, high: np.ndarray, logs: np.ndarray):
        # of grams that mix alike only one stays; the others count as missing
        self.mixed, kept = np.unique(mixed(key, high), return_index=True)
        self.key, self.high, self.logs = key[kept], high[kept], logs[kept]

    def find(self, key: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A row for each gram, and whether it is here."""
        at = np.minimum(np.searchsorted(self.mixed, mixed(key, high)), len(self.key) - 1)
        return at, (self.key[at] == key) & (self.high[at] == high)


def mixed(key: np.ndarray, high: np.ndarray) -> np.ndarray:
    return key ^ (high * np.int64(0x5E3779B97F4A7C15)) if high.any() else key


def logs_of(model: DataFrame, folds: int, *more: str) -> DataFrame:
    """(lang, high, key, l0, l1 ...): logs in whole units."""
    return model.select("lang", "high", "key", *more, *[F.round(F.log(f"p{i}") * UNIT).cast("long").alias(f"l{i}") for i in range(folds)])


def frequent(model: DataFrame, folds: int) -> dict[str, Frequent]:
    """The most frequent grams of each language: at most COMMON rows come back, whatever the model's size."""
    level = F.floor(F.log2("seen") * 16)
    sizes = {r["level"]: r["count"] for r in model.groupBy(level.alias("level")).count().collect()}
    least, n = None, 0
    for at in sorted(sizes, reverse=True):
        n += sizes[at]
        if n > COMMON:
            break
        least = at
    if least is None:
        return {}
    got = logs_of(model.where(level >= least), folds).toArrow()
    langs, key, high = got["lang"].to_pandas().to_numpy(), got["key"].to_numpy(), got["high"].to_numpy()
    logs = np.stack([got[f"l{i}"].to_numpy() for i in range(folds)], axis=1)
    return {lang: Frequent(*(x[langs == lang] for x in (key, high, logs))) for lang in {*langs.tolist()}}


def score(docs: DataFrame, model: DataFrame, folds: int = 1) -> DataFrame:
    """(doc_id, lang, the base counts, base_failed, log_perplexity) of every row.

    ``model`` is the highest of the ``orders``, counted over the same texts and folds, and spread by
    its keys.
    A text without characters has no perplexity.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    tables = frequent(model, folds)

    def run(c: dict):
        texts, own_fold = texts_of(c["text"]), c["fold"].to_numpy()
        chars, near = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        rest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for lang, chosen in by_language(c["lang"].to_pylist(), texts):
            key, high, sizes = wide_grams([texts[i] for i in chosen])
            owner = np.repeat(np.array(chosen, np.int64), sizes)
            chars[chosen] = sizes
            missing = np.ones(len(key), dtype=bool)
            if lang in tables:
                at, here = tables[lang].find(key, high)
                value = tables[lang].logs[at, own_fold[owner]]
                sums = np.concatenate([[0], np.where(here, value, 0).cumsum()])
                ends = np.cumsum(sizes)
                near[chosen], missing = sums[ends] - sums[ends - sizes], ~here
            rest.append((owner[missing], high[missing], key[missing]))
        owner, high, key = (np.concatenate(x) for x in zip(*rest, strict=True))
        order = np.argsort(owner, kind="stable")
        ends = np.concatenate([[0], np.bincount(owner, minlength=len(texts)).cumsum()])
        pairs = pa.StructArray.from_arrays([pa.array(high[order]), pa.array(key[order])], ["high", "key"])
        counts = zip(*(base_counts(t) for t in texts), strict=True)
        out = {"row": row_number_base(len(texts)), "fold": c["fold"], "doc_id": c["doc_id"], "lang": c["lang"], "chars": chars, "near": near}
        return out | {"rest": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)} | dict(zip(names, map(list, counts), strict=True))

    kinds = ", ".join(f"{n} long" for n in names)
    dealt = docs.select("doc_id", "lang", "text", fold(folds).alias("fold"))
    schema = f"row long, fold int, doc_id {dict(docs.dtypes)['doc_id']}, lang string, chars long, near long, rest array<struct<high: long, key: long>>, {kinds}"
    rows = stored(map_rows(dealt, run, schema), "rows")
    far = rows.select("row", "fold", F.coalesce("lang", F.lit("")).alias("lang"), F.explode("rest").alias("g")).select("row", "fold", "lang", "g.high", "g.key")
    own = reduce(lambda c, i: c.when(F.col("fold") == i, F.col(f"l{i}")), range(1, folds), F.when(F.col("fold") == 0, F.col("l0")))
    met = far.join(logs_of(model, folds), ["lang", "high", "key"]).groupBy("row").agg(F.sum(own).alias("far"), F.count("*").alias("n_far"))
    whole = F.when(F.size("rest") == F.coalesce("n_far", F.lit(0)), F.col("near") + F.coalesce("far", F.lit(0))).otherwise(
        F.raise_error(F.lit("a gram of a text is not in the model")).cast("long")
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    per_char = F.when(F.col("chars") > 0, -whole / F.col("chars") / UNIT)
    return rows.join(met, "row", "left").select("doc_id", "lang", *names, per_char.alias("log_perplexity"), failed.alias("base_failed"))


def bands(scored: DataFrame, width: float = BAND) -> DataFrame:
    """(lang, low, high): median of the documents that pass the base rules, minus and plus the spread."""
    fine = scored.where("NOT base_failed AND log_perplexity IS NOT NULL").select(F.coalesce("lang", F.lit("")).alias("lang"), "log_perplexity")
    # stored, so that the size of this table, a row per language, is known and decides on a broadcast
    middle = stored(fine.groupBy("lang").agg(F.percentile_approx("log_perplexity", 0.5, 100_000).alias("middle")), "medians")
    away = fine.join(middle, "lang").groupBy("lang", "middle").agg(
        F.percentile_approx(F.abs(F.col("log_perplexity") - F.col("middle")), 0.5, 100_000).alias("spread")
    )
    return away.select("lang", (F.col("middle") - width * F.col("spread")).alias("low"), (F.col("middle") + width * F.col("spread")).alias("high"))


def rules(docs: DataFrame, width: float = BAND, folds: int = FOLDS) -> DataFrame:
    """One row per row of ``docs``: the base counts, base_failed, kept, lang and log_perplexity.

    kept: not base_failed and log perplexity inside its language's bounds.  NULL and empty texts
    have no words and fail; rows without a language form one of their own; a language with a spread
    of zero keeps exactly its median.  Other columns are not read.
    """
    scored = stored(score(docs, orders(count(docs, folds))[-1], folds), "scored")
    b = stored(bands(scored, width).withColumnRenamed("lang", "_lang"), "bands")
    out = scored.join(b, F.coalesce("lang", F.lit("")) == F.col("_lang"), "left")
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low") - 1e-9, F.col("high") + 1e-9), F.lit(False))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & inside).alias("kept"), "lang", "log_perplexity", F.col("low").alias("low_bound"), F.col("high").alias("high_bound"),
    )
