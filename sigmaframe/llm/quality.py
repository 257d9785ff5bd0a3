"""Rule and perplexity filter: base text statistics and an n-gram language model with bands by language.

The model is a character 5-gram model with modified Kneser-Ney smoothing, one for each language.
Spark counts the n-grams of all texts; probabilities come from joins between the count tables of
neighbouring orders. Scoring reads a sorted array of n-gram hashes and their log-probabilities. A
text is rejected if its perplexity lies outside its language's band: the median of the logarithms
plus or minus a multiple of their robust spread, wider for short texts by their chance error.

Nulls count as empty texts, have no words and fail the base rules; a null language is a language of
its own. Repeated rows are counted and scored each on its own. Texts of fewer than five characters
have no perplexity and are left to the base rules.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import U64, HashArray, Rolling, Texts, fewer_tasks, mix, shared_folder, small_batches, stored

ORDER = 5
#: Largest number of n-grams whose hashes and scores (16 bytes each) are broadcast; beyond it, scoring joins, to the same result.
BROADCAST_GRAMS = 4_000_000
#: Distinct n-grams that a counting task holds before it hands them on.
TASK_GRAMS = 1_000_000
SLICE_BYTES = 1 << 20
#: Band in robust standard deviations of log-perplexity below and above the median, and the least deviation.
BELOW, ABOVE, LEAST_SPREAD = 3.2, 2.6, 0.03
#: Words at which the chance error of a text's log-perplexity equals the deviation between texts; bands widen for shorter texts.
NOISE_WORDS = 150
SYMBOLS = b"#*$%&|<>"

BASE_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _sums(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])


def base_statistics(texts: Texts) -> dict[str, np.ndarray]:
    """The base counts of each text in a slice."""
    data, n = texts.data, len(texts)
    first, last, owner = texts.words()
    roll = Rolling(data)
    out = {"n_words": np.bincount(owner, minlength=n)}
    points = _sums((data & 0xC0) != 0x80)
    out["word_chars"] = np.bincount(owner, (points[last] - points[first]).astype(float), n).astype(np.int64)
    is_symbol = np.zeros(256, bool)
    is_symbol[np.frombuffer(SYMBOLS, np.uint8)] = True
    symbols = _sums(is_symbol[data])
    out["n_symbols"] = symbols[texts.offsets[1:]] - symbols[texts.offsets[:-1]]

    breaks = np.flatnonzero(data == 10)
    of = texts.owner(breaks)
    starts = np.concatenate([texts.offsets[:-1], breaks + 1])
    ends = np.concatenate([breaks, texts.offsets[1:]])
    line_owner = np.concatenate([np.arange(n), of])
    order = np.lexsort((starts, line_owner))
    starts, line_owner = starts[order], line_owner[order]
    ends = ends[np.lexsort((ends, np.concatenate([of, np.arange(n)])))]
    worded = np.searchsorted(first, starts) < np.searchsorted(first, ends)
    key = texts.hashes(starts[worded], ends[worded], roll) ^ mix(line_owner[worded].astype(U64) + U64(1))
    own = line_owner[worded]
    _, where = np.unique(key, return_index=True)
    out["n_dup_lines"] = np.bincount(own, minlength=n) - np.bincount(own[where], minlength=n)

    words = texts.hashes(first, last, roll)
    covered = np.zeros(len(words) + 1, np.int64)
    if len(words) >= 5:
        within = np.flatnonzero(owner[4:] == owner[:-4])
        key = Rolling(words).windows(5)[within] ^ mix(owner[within].astype(U64) + U64(1))
        order = np.argsort(key)
        ordered = key[order]
        same = ordered[1:] == ordered[:-1]
        again = np.zeros(len(key), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        hit = within[again]
        covered = np.bincount(hit, minlength=len(words) + 1) - np.bincount(hit + 5, minlength=len(words) + 1)
    out["n_repeat_words"] = np.bincount(owner[np.cumsum(covered[:-1]) > 0], minlength=n)
    return out


def _language_codes(column: pa.Array) -> np.ndarray:
    names = column.to_pylist()
    known = {v: zlib.crc32(b"" if v is None else b"=" + v.encode()) for v in set(names)}
    return mix(np.array([known[v] for v in names], U64) + U64(7))


def _grams(texts: Texts, languages: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, starts of the n-grams inside single texts, and their hashes with the language."""
    points = np.frombuffer(texts.data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    lead = _sums((texts.data & 0xC0) != 0x80)
    bounds = lead[texts.offsets]
    sizes = np.diff(bounds)
    hashes = Rolling(mix(points.astype(U64))).windows(ORDER)
    whole = np.ones(len(points), bool)
    for k in range(1, ORDER):
        whole[(bounds[1:] - k)[sizes >= k]] = False
    starts = np.flatnonzero(whole)
    return points, starts, hashes[starts] ^ np.repeat(languages, sizes)[starts]


def count_grams(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, gram, n) over all texts, counted in each task before the shuffle."""

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []

        def merged():
            keys, counts, names, points = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            new = np.concatenate([[True], keys[1:] != keys[:-1]])
            heads = np.flatnonzero(new)
            return keys[heads], np.add.reduceat(counts, heads), names[order[heads]], points[order[heads]]

        labels: dict = {}
        kinds: list = []

        def rows(part):
            keys, counts, names, points = part
            grams = points.astype("<u4").tobytes().decode("utf-32-le")
            text = [grams[k : k + ORDER] for k in range(0, len(grams), ORDER)]
            for k in range(0, len(keys), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array([kinds[x] for x in names[k : k + 50_000]], pa.string()), pa.array(text[k : k + 50_000]), pa.array(counts[k : k + 50_000])], ["lang", "gram", "n"])

        for batch in batches:
            codes = _language_codes(batch.column(1))
            names = batch.column(1).to_pylist()
            for v in names:
                if v not in labels:
                    labels[v] = len(kinds)
                    kinds.append(v)
            numbers = np.array([labels[v] for v in names], np.int32)
            for low, texts in Texts.of(batch.column(0)).slices(SLICE_BYTES):
                own = slice(low, low + len(texts))
                points, starts, keys = _grams(texts, codes[own])
                if not len(keys):
                    continue
                ordered = np.sort(keys)
                heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
                unique, counts = ordered[heads], np.diff(np.append(heads, len(ordered)))
                at, _ = HashArray(unique).find(keys)
                seen = np.zeros(len(unique), np.int64)
                seen[at] = starts
                owner = np.searchsorted(_sums((texts.data & 0xC0) != 0x80)[texts.offsets], seen, "right") - 1
                held.append((unique, counts, numbers[own][owner], points[seen[:, None] + np.arange(ORDER)]))
                if sum(len(x[0]) for x in held) > TASK_GRAMS:
                    held = [merged()]
                    if len(held[0][0]) > TASK_GRAMS // 2:
                        yield from rows(held.pop())
        if held:
            yield from rows(merged())

    counted = docs.select(text_col, lang_col).mapInArrow(run, "lang string, gram string, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame, folder: str, order: int = ORDER) -> DataFrame:
    """(lang, gram, logp) of the highest order from (lang, gram, n): interpolated, with three discounts an order.

    Lower orders count the distinct characters seen before an n-gram instead of its occurrences.
    """
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        # each table is written once; its few rows then go through few tasks
        levels[k] = stored(levels[k + 1].groupBy("lang", F.expr(f"substring(gram, 2, {k})").alias("gram")).agg(F.count("*").alias("n")), folder, f"level{k}")
    lower = None
    for k in range(1, order + 1):
        of = [F.sum(F.when(F.col("n") == j, 1).otherwise(0)).cast("double").alias(f"t{j}") for j in range(1, 5)]
        d = levels[k].groupBy("lang").agg(*of, F.count("*").alias("kinds"))
        y = F.expr("try_divide(t1, t1 + 2 * t2)")
        raw = [(F.lit(1) - 2 * y * F.expr("try_divide(t2, t1)"), 0.5, 1.0), (F.lit(2) - 3 * y * F.expr("try_divide(t3, t2)"), 1.0, 2.0), (F.lit(3) - 4 * y * F.expr("try_divide(t4, t3)"), 1.5, 3.0)]
        y_safe = F.col("t1") > 0
        d = d.select(F.col("lang").alias("d_lang"), "kinds", *(F.when(y_safe & v.isNotNull() & (v > 0) & (v <= most), v).otherwise(F.lit(other)).alias(f"d{j}") for j, (v, other, most) in enumerate(raw, 1)))
        context = F.expr(f"substring(gram, 1, {k - 1})")
        c = levels[k].groupBy(F.col("lang").alias("c_lang"), context.alias("context")).agg(F.sum("n").alias("total"), *(F.sum(F.when(F.col("n") >= 3 if j == 3 else F.col("n") == j, 1).otherwise(0)).alias(f"n{j}") for j in (1, 2, 3)))
        x = levels[k].join(c, F.col("lang").eqNullSafe(F.col("c_lang")) & (context == F.col("context"))).join(d, F.col("lang").eqNullSafe(F.col("d_lang")))
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        if lower is None:
            below = F.lit(1.0) / (F.col("kinds") + 1)
        else:
            x = x.join(lower, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.expr(f"substring(gram, 2, {k - 1})") == F.col("l_gram")))
            below = F.col("l_p")
        p = (F.greatest(F.col("n") - cut, F.lit(0.0)) + (F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")) * below) / F.col("total")
        if k < order:
            lower = stored(x.select(F.col("lang").alias("l_lang"), F.col("gram").alias("l_gram"), p.alias("l_p")), folder, f"p{k}")
    return x.select("lang", "gram", F.log(p).alias("logp"))


def _gram_keys(frame: DataFrame) -> DataFrame:
    """(key, logp): the hash that scoring looks up."""

    def run(batches):
        for batch in batches:
            points = np.frombuffer("".join(batch.column(1).to_pylist()).encode("utf-32-le"), "<u4")
            keys = Rolling(mix(points.astype(U64))).windows(ORDER)[::ORDER] if batch.num_rows else np.zeros(0, U64)
            yield pa.RecordBatch.from_arrays([pa.array((keys ^ _language_codes(batch.column(0))).view(np.int64)), batch.column(2)], ["key", "logp"])

    return frame.select("lang", "gram", "logp").mapInArrow(run, "key long, logp double")


def _perplexities(docs: DataFrame, model: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """docs with base counts, n_grams and log_ppl (null without n-grams)."""
    spark, names = docs.sparkSession, docs.columns
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    stats = [f"{x} long" for x in (*BASE_FIELDS, "n_grams")]
    size = model.count()
    shared = None
    if size <= BROADCAST_GRAMS:
        table = model.toArrow()
        keys, logp = table.column(0).to_numpy().view(U64), table.column(1).to_numpy()
        order = np.argsort(keys)
        shared = spark.sparkContext.broadcast((keys[order], logp[order]))

    def run(batches):
        array = None
        for batch in batches:
            codes = _language_codes(batch.column(names.index(lang_col)))
            for low, texts in Texts.of(batch.column(names.index(text_col))).slices(SLICE_BYTES):
                n = len(texts)
                base = base_statistics(texts)
                points, starts, keys = _grams(texts, codes[low : low + n])
                owner = np.searchsorted(_sums((texts.data & 0xC0) != 0x80)[texts.offsets], starts, "right") - 1
                grams = np.bincount(owner, minlength=n)
                own = [*batch.slice(low, n).columns, *(pa.array(base[x].astype(np.int64)) for x in BASE_FIELDS), pa.array(grams)]
                if shared is not None:
                    if array is None:
                        array = HashArray(shared.value[0])
                    at, _ = array.find(keys)
                    total = np.bincount(owner, shared.value[1][np.minimum(at, max(0, len(array.keys) - 1))].astype(float) if len(keys) else None, n)
                    own.append(pa.array(-total / np.maximum(grams, 1), mask=grams == 0))
                else:
                    order = np.lexsort((keys, owner))
                    o, k = owner[order], keys[order]
                    heads = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (k[1:] != k[:-1])])) if len(o) else np.zeros(0, np.int64)
                    at = np.concatenate([[0], np.cumsum(np.bincount(o[heads], minlength=n))]).astype(np.int32)
                    own.append(pa.ListArray.from_arrays(pa.array(at), pa.array(k[heads].view(np.int64))))
                    own.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.diff(np.append(heads, len(o))))))
                yield pa.RecordBatch.from_arrays(own, [*names, *BASE_FIELDS, "n_grams", *(["log_ppl"] if shared is not None else ["keys", "times"])])

    if shared is not None:
        return docs.mapInArrow(run, ", ".join([*fields, *stats, "log_ppl double"]))
    scored = stored(docs.mapInArrow(run, ", ".join([*fields, *stats, "keys array<long>", "times array<long>"])).withColumn("row", F.monotonically_increasing_id()), shared_folder(spark), "grams")
    flat = scored.select("row", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.times").alias("times"))
    sums = flat.join(model, "key").groupBy(F.col("row").alias("s_row")).agg((-F.sum(F.col("times") * F.col("logp"))).alias("s"))
    return scored.join(sums, F.col("row") == F.col("s_row"), "left").withColumn("log_ppl", F.expr("try_divide(s, n_grams)")).drop("row", "s_row", "s", "keys", "times")


def filter_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """Per document: id, language, base counts, log-perplexity with its language's band, base_failed and kept."""
    small_batches(docs.sparkSession)
    folder = shared_folder(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = stored(count_grams(fewer_tasks(rows), "text", "lang"), folder, "counts")
    model = stored(_gram_keys(kneser_ney(counts, folder)), folder, "model")
    scored = stored(_perplexities(rows, model, "text", "lang").drop("text"), folder, "scores")
    middle = scored.where("log_ppl is not null").groupBy("lang").agg(F.percentile_approx("log_ppl", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10_000).alias("q"))
    spread = F.greatest((F.col("q")[2] - F.col("q")[0]) / 1.349, F.lit(LEAST_SPREAD))
    bands = middle.select(F.col("lang").alias("b_lang"), F.col("q")[1].alias("middle"), spread.alias("spread"))
    wider = F.sqrt(1 + NOISE_WORDS / F.greatest(F.col("n_words"), F.lit(1)))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    inside = F.col("log_ppl").isNull() | F.col("log_ppl").between(F.col("band_low"), F.col("band_high"))
    return (
        scored.join(bands, F.col("lang").eqNullSafe(F.col("b_lang")), "left")
        .withColumns({"band_low": F.col("middle") - below * F.col("spread") * wider, "band_high": F.col("middle") + above * F.col("spread") * wider})
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & inside)
        .select("doc_id", *BASE_FIELDS, "base_failed", "kept", "lang", "log_ppl", "band_low", "band_high")
    )
