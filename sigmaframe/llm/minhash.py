"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

A text's shingles are its runs of five words (all words, if it has fewer); a shingle weighs its
number of occurrences times log(1 + documents / documents with it). Each of SAMPLES consistent
samples draws one (shingle, level) pair; two texts draw the same pair with a probability equal to
their weighted Jaccard similarity. Texts that agree in a whole band of samples are candidates, and
candidates are verified by their weighted Jaccard similarity, in double precision. Classes are the
connected components of the verified links.

Two bounds leave out only what can't be similar. A link's common weight lies on shingles that several
documents have, so a text with less than the threshold's share of its weight on such shingles links
with nothing and isn't sampled; and no pair has more common weight than either text has there.

Equal texts are one node, however many there are. A band's texts are not compared in all pairs: in
rounds, every text of a class that differs from that of the band's representative is compared with the
representative, and classes are joined after each round. What then lies in one band and in different
classes is compared in cells of at most CELL texts a side, each pair in the first band it shares, and
each text is sent once to a cell. A band whose texts are one class is done.

Nulls and texts without words have no shingles and are alone. Rows that repeat an id are one class if
their texts are alike; a null id is left out of the links and alone. Ties between equal texts go to
the smallest id. Extra columns, whatever their names, stay as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, LAST, pack, rows_of, texts_of, unpack, write_blocks
from .components import components
from .suffixes import _buckets, _slices
from .textkit import U64, Rolling, Texts, discard, mix, renamed, shared_folder, stored, trim

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 4
SAMPLES = BANDS * ROWS
SLICE_BYTES = 1 << 20
#: Pairs with a representative that are verified together.
GROUP_PAIRS = 400
#: Texts, and bytes of their shingles, on each side of a cell.
CELL, CELL_BYTES = 128, 4 << 20
#: Rounds go on while each halves the pairs that are left and more than this are left for each text of a band.
FEW_PAIRS = 8
TABLE = 1 << 16
#: Shingles that are sampled together.
CACHED = 1 << 14
#: Share of a weight that rounding may hide.
SLACK = 1e-9
_MULTIPLIERS = mix(np.arange(1, SAMPLES + 1, dtype=U64)) | U64(1)


def _random_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r = np.random.default_rng(20)
    return r.gamma(2, 1, TABLE).astype(np.float32), np.log(r.gamma(2, 1, TABLE)).astype(np.float32), r.random(TABLE).astype(np.float32)


_TABLES: list = []


def shingles(texts: Texts, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, by text and hash: text, hash, occurrences."""
    first, last, owner = texts.words()
    hashes = texts.hashes(first, last)
    n = np.bincount(owner, minlength=len(texts))
    begin = np.cumsum(n) - n
    roll = Rolling(hashes)
    start = np.flatnonzero(owner[words - 1 :] == owner[: len(owner) - words + 1]) if len(owner) >= words else np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < words))
    key = np.concatenate([roll.of(start, start + words), roll.of(begin[short], begin[short] + n[short])])
    own = np.concatenate([owner[start], short])
    order = np.lexsort((key, own))
    key, own = key[order], own[order]
    heads = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])])) if len(key) else np.zeros(0, np.int64)
    return own[heads], key[heads], np.diff(np.append(heads, len(key)))


def _block_shingles(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [(low + own, key, times) for low, part in texts.slices(SLICE_BYTES) for own, key, times in [shingles(part)]]
    return tuple(map(np.concatenate, zip(*parts))) if parts else (np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64))


def document_counts(blocks: DataFrame, buckets: int) -> DataFrame:
    """(block, counts): for each block and bucket, the number of documents with each of the block's shingles, in order."""

    def send(batches):
        for batch in batches:
            for row in rows_of(batch):
                key = np.sort(_block_shingles(texts_of(row)[1])[1])
                heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                n, key = np.diff(np.append(heads, len(key))), key[heads]
                at = _slices(key, buckets)
                own = [k for k in range(buckets) if at[k] < at[k + 1]]
                columns = [own, [row["block"]] * len(own), [key[at[k] : at[k + 1]].tobytes() for k in own], [pack(n[at[k] : at[k + 1]].astype("<u4")) for k in own]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "block", "hashes", "n"])
            trim()

    def meet(table):
        rows = table.to_pylist()
        parts = [np.frombuffer(r["hashes"], U64) for r in rows]
        hashes, n = np.concatenate(parts), np.concatenate([unpack(r["n"], "<u4") for r in rows]).astype(np.int64)
        at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        del rows, parts
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        total = np.empty(len(hashes), np.int64)
        total[order] = np.repeat(np.add.reduceat(n[order], heads), np.diff(np.append(heads, len(order))))
        out = pa.table([table.column("block").combine_chunks(), table.column("bucket").combine_chunks(), pa.array([pack(total[a:b].astype("<u4")) for a, b in zip(at[:-1], at[1:])], pa.binary())], ["block", "bucket", "n"])
        del hashes, n, order, ordered, total
        trim()
        return out

    sent = blocks.select("block", "ids", "offsets", "data").mapInArrow(send, "bucket int, block long, hashes binary, n binary")
    met = sent.groupBy("bucket").applyInArrow(meet, "block long, bucket int, n binary")
    return met.groupBy("block").agg(F.collect_list(F.struct("bucket", "n")).alias("counts"))


def _weighted(texts: Texts, counts: list[dict] | None, documents: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, shingle, weight and number of documents of a block's shingles."""
    own, key, times = _block_shingles(texts)
    unique = np.unique(key)
    parts = {c["bucket"]: unpack(c["n"], "<u4") for c in counts or []}
    n = np.concatenate([parts[k] for k in sorted(parts)]) if parts else np.zeros(0, "<u4")
    n = n[np.searchsorted(unique, key)]
    return own, key, times * np.log1p(documents / n.astype(np.float64)), n


def samples(own: np.ndarray, key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts that have shingles, and their SAMPLES samples (uint64), one row a text."""
    if not _TABLES:
        _TABLES.extend(_random_tables())
    gamma, log_gamma, uniform = _TABLES
    heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    out = np.zeros((len(heads), SAMPLES), U64)
    best = np.full((len(heads), SAMPLES), np.inf, np.float32)
    log_weight = np.log(weight).astype(np.float32)
    for low in range(0, len(own), CACHED):
        # as many shingles as fit a processor's cache; a longer text goes on in the next part
        some = slice(low, min(low + CACHED, len(own)))
        k_some = key[some]
        text = np.searchsorted(heads, [low, some.stop - 1], "right") - 1
        first = np.maximum(heads[text[0] : text[1] + 1], low) - low
        size = np.diff(np.append(first, len(k_some)))
        to = slice(text[0], text[1] + 1)
        for k in range(SAMPLES):
            h = k_some * _MULTIPLIERS[k]
            which = (h >> U64(48)).view(np.int64)
            r, b = gamma[which], uniform[((h >> U64(32)) & U64(TABLE - 1)).view(np.int64)]
            level = np.floor(log_weight[some] / r + b)
            rate = log_gamma[((h >> U64(16)) & U64(TABLE - 1)).view(np.int64)] - r * (level + (1 - b))
            lowest = np.minimum.reduceat(rate, first)
            least = np.flatnonzero(rate == np.repeat(lowest, size))
            # of equal rates, the last in order of the hash
            drawn = np.zeros(len(first), U64)
            drawn[np.searchsorted(first, least, "right") - 1] = k_some[least] ^ mix(level[least].astype(np.int64).view(U64))
            better = lowest <= best[to, k]
            best[to, k] = np.where(better, lowest, best[to, k])
            out[to, k] = np.where(better, drawn, out[to, k])
    return own[heads], mix(out)


def sketches(blocks: DataFrame, counts: DataFrame, documents: int, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each different text of a block that can have a link: digest, block, weight, weight on shared shingles, bands, shingles and weights."""
    kind = "digest string, block long, weight double, shared double, size long, bands array<long>, keys binary, weights binary"

    def run(batches):
        for batch in batches:
            for row in rows_of(batch):
                ids, texts = texts_of(row)
                own, key, weight, n = _weighted(texts, row["counts"], documents)
                whole = np.bincount(own, weight, len(texts))
                shared = np.bincount(own, np.where(n > 1, weight, 0.0), len(texts))
                # equal texts of a block count once
                digests = {k: hashlib.md5(texts.bytes_of(k)).hexdigest() for k in np.flatnonzero((whole > 0) & (shared >= threshold * whole * (1 - SLACK)) & (ids != LAST))}
                chosen = np.array(sorted({d: k for k, d in digests.items()}.values()), np.int64)
                keep = np.isin(own, chosen)
                own, key, weight = own[keep], key[keep], weight[keep]
                docs, drawn = samples(own, key, weight)
                at = np.searchsorted(own, np.append(docs, len(texts)))
                flat = Rolling(drawn.reshape(-1))
                bands = np.stack([mix(flat.of(np.arange(len(docs)) * SAMPLES + b * ROWS, np.arange(len(docs)) * SAMPLES + (b + 1) * ROWS) + U64(b)) for b in range(BANDS)], 1).view(np.int64)
                for low in range(0, len(docs), 64):
                    some = range(low, min(low + 64, len(docs)))
                    spans = [slice(at[k], at[k + 1]) for k in some]
                    columns = [
                        pa.array([digests[docs[k]] for k in some]), pa.array([row["block"]] * len(some), pa.int64()), pa.array(whole[docs[some]]), pa.array(shared[docs[some]]), pa.array([16 * (s.stop - s.start) for s in spans], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * BANDS), pa.array(bands[some].reshape(-1))),
                        pa.array([key[s].tobytes() for s in spans], pa.binary()), pa.array([weight[s].astype("<f8").tobytes() for s in spans], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["digest", "block", "weight", "shared", "size", "bands", "keys", "weights"])
            trim()

    return blocks.select("block", "ids", "offsets", "data").join(counts, "block", "left").mapInArrow(run, kind)


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Common and joint weight of two texts' shingles, each sorted by hash."""
    (kx, wx), (ky, wy) = (x, y) if len(x[0]) >= len(y[0]) else (y, x)
    at = np.minimum(np.searchsorted(kx, ky), len(kx) - 1)
    both = kx[at] == ky
    common = np.minimum(wx[at[both]], wy[both]).sum()
    return common, wx.sum() + wy.sum() - common


def _vectors(table: pa.Table) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    c = [table.column(n).to_pylist() for n in ("digest", "keys", "weights")]
    return {d: (np.frombuffer(k, U64), np.frombuffer(w, "<f8")) for d, k, w in zip(*c)}


def _possible(a: str, b: str, threshold: float):
    """Whether the weights of the texts of two struct columns allow a link."""
    least = F.least(F.col(f"{a}.shared"), F.col(f"{b}.shared"))
    return least >= (1 - SLACK) * threshold * (F.col(f"{a}.weight") + F.col(f"{b}.weight") - least)


def _chosen(found: DataFrame, texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The shingles of the wanted (task, digest) rows."""
    place = wanted.distinct().join(texts.select("digest", "block"), "digest")
    return place.join(found.select("digest", "block", "keys", "weights"), ["digest", "block"]).select((F.col("task") + 0).alias("task"), F.concat("digest").alias("digest"), "keys", "weights")


def verify(pairs: DataFrame, found: DataFrame, texts: DataFrame, folder: str, name: str, threshold: float = THRESHOLD) -> DataFrame:
    """Those of the distinct pairs (a, b) of digests that are similar."""
    pairs = stored(pairs, folder, f"{name}-pairs")
    # a representative's pairs are dealt over several tasks
    many = pairs.groupBy(F.col("a").alias("of")).agg(F.ceil(F.count("*") / (GROUP_PAIRS // 2)).alias("salts"))
    tasks = max(16, -(-pairs.count() // GROUP_PAIRS))
    dealt = pairs.join(many, F.col("a") == F.col("of")).withColumn("task", F.pmod(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("salts"))), F.lit(tasks)).cast("int"))
    dealt = stored(dealt.select("task", "a", "b"), folder, f"{name}-dealt")
    wanted = dealt.select("task", F.col("a").alias("digest")).union(dealt.select("task", "b"))

    def meet(left, right):
        vectors = _vectors(right)
        a, b = left.column("a").to_pylist(), left.column("b").to_pylist()
        hit = [c >= threshold * j for c, j in (similarity(vectors[x], vectors[y]) for x, y in zip(a, b))]
        del vectors
        trim()
        return left.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return stored(dealt.groupBy("task").cogroup(_chosen(found, texts, wanted).groupBy("task")).applyInArrow(meet, "a string, b string"), folder, f"{name}-similar")


def _classed(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("class", F.col("digest"))
    return members.join(labels, F.col("digest") == F.col("node"), "left").withColumn("class", F.coalesce("label", "digest")).drop("node", "label")


def _star(classed: DataFrame, turn: int, threshold: float) -> DataFrame:
    """Each band's texts with the band's representative of this turn, where the classes differ and the weights allow a link."""
    text = F.struct("digest", "class", "weight", "shared")
    first = classed.groupBy(F.col("band").alias("of")).agg(F.min_by(text, F.struct(F.xxhash64("digest", F.lit(turn)), "digest")).alias("y"), F.min("class").alias("low"), F.max("class").alias("high"))
    first = first.where("low != high").select("of", "y")
    near = classed.select("band", text.alias("x")).join(first, F.col("band") == F.col("of")).where((F.col("x.class") != F.col("y.class")) & _possible("x", "y", threshold))
    return near.select(F.least("x.digest", "y.digest").alias("a"), F.greatest("x.digest", "y.digest").alias("b")).distinct()


def _left_open(classed: DataFrame) -> DataFrame:
    """Per band with several classes: its texts, its largest class, and the texts outside of that with the pairs they are in."""
    each = classed.groupBy("band", "class").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    whole = each.groupBy(F.col("band").alias("of")).agg(F.max(F.struct("n", "class")).alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max_by("bytes", F.struct("n", "class")).alias("top_bytes"))
    return whole.where("top.n < n").select("of", F.col("top.class").alias("top"), "n", "bytes", (F.col("n") - F.col("top.n")).alias("open"), (F.col("bytes") - F.col("top_bytes")).alias("open_bytes"))


def _cells(classed: DataFrame, open_: DataFrame, found: DataFrame, texts: DataFrame, folder: str, threshold: float) -> DataFrame:
    """Links between the texts outside of a band's largest class and all its texts, enough to join their classes."""
    sides = open_.select("of", "top", *(F.ceil(F.greatest(F.col(n) / CELL, F.col(b) / CELL_BYTES)).cast("int").alias(s) for n, b, s in (("open", "open_bytes", "rows"), ("n", "bytes", "columns"))))
    both = classed.join(sides, F.col("band") == F.col("of"))
    text = ["digest", "class", "weight", "shared", "bands"]
    part = lambda n: F.pmod(F.xxhash64("digest"), F.col(n)).cast("int")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = both.where(F.col("class") != F.col("top")).select("band", "top", *text, part("rows").alias("i"), span("columns").alias("j"), F.lit(0).alias("side"))
    right = both.select("band", "top", *text, span("rows").alias("i"), part("columns").alias("j"), F.lit(1).alias("side"))
    tasks = max(16, int(open_.select(F.sum(F.ceil(F.col("open") / CELL) * F.ceil(F.col("n") / CELL))).first()[0] or 0) // 8)
    dealt = left.union(right).withColumn("task", F.pmod(F.xxhash64("band", "i", "j"), F.lit(tasks)).cast("int"))
    dealt = stored(dealt, folder, "cells")

    def meet(rows, vectors):
        vectors, a, b = _vectors(vectors), [], []
        digest, group = (np.array(rows.column(c).to_pylist(), object) for c in ("digest", "class"))
        band, i, j, side = (rows.column(c).to_numpy() for c in ("band", "i", "j", "side"))
        weight, shared = (rows.column(c).to_numpy() for c in ("weight", "shared"))
        bands = np.stack(rows.column("bands").to_pylist())
        root = {}

        def top(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        order = np.lexsort((digest.astype(str), side, j, i, band))
        edge = np.flatnonzero(np.concatenate([[True], (np.diff(band[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0), [True]]))
        for low, high in zip(edge[:-1], edge[1:]):
            cell = order[low:high]
            rows_, columns = cell[side[cell] == 0], cell[side[cell] == 1]
            outside = set(digest[rows_])
            for x in rows_:
                least = np.minimum(shared[x], shared[columns])
                ok = least >= (1 - SLACK) * threshold * (weight[x] + weight[columns] - least)
                first = (bands[columns] == bands[x]).argmax(1)
                ok &= bands[x][first] == band[x]  # a pair is compared in the first band that it shares
                for y in columns[ok]:
                    if digest[x] == digest[y] or (digest[y] in outside and digest[y] < digest[x]):
                        continue
                    u, v = top(group[x]), top(group[y])
                    if u != v:
                        common, joint = similarity(vectors[digest[x]], vectors[digest[y]])
                        if common >= threshold * joint:
                            root[max(u, v)] = min(u, v)
                            a.append(digest[x])
                            b.append(digest[y])
        del vectors
        trim()
        return pa.table([pa.array(a, pa.string()), pa.array(b, pa.string())], ["a", "b"])

    chosen = _chosen(found, texts, dealt.select("task", "digest"))
    return stored(dealt.groupBy("task").cogroup(chosen.groupBy("task")).applyInArrow(meet, "a string, b string"), folder, "cell-links")


def linked_texts(found: DataFrame, folder: str, threshold: float = THRESHOLD) -> DataFrame | None:
    """(node, label): the class of every linked digest; None without candidates."""
    texts = stored(found.groupBy("digest").agg(F.min("block").alias("block"), F.min_by(F.struct("weight", "shared", "size", "bands"), "block").alias("t")).select("digest", "block", "t.*"), folder, "texts")
    banded = texts.select("digest", F.explode("bands").alias("band"))
    several = banded.groupBy(F.col("band").alias("of")).agg(F.count("*").alias("n")).where("n > 1").select("of")
    placed = banded.join(several, F.col("band") == F.col("of")).drop("of").join(texts.drop("block"), "digest")
    members = stored(placed, folder, "members")
    number = members.count()
    if not number:
        return None
    labels, links, turn, before = None, None, 0, None
    while True:
        similar = verify(_star(_classed(members, labels), turn, threshold), found, texts, folder, f"star{turn}", threshold)
        fresh = not similar.isEmpty()
        if fresh:
            links = similar if links is None else links.union(similar)
            labels = components(links, f"{folder}/classes{turn}")
        classed = _classed(members, labels)
        open_ = stored(_left_open(classed), folder, f"open{turn}")
        pairs = open_.select(F.sum(F.col("open") * F.col("n"))).first()[0]
        turn += 1
        if not pairs:
            return labels
        if pairs <= FEW_PAIRS * number or before is not None and 2 * pairs > before:
            break
        before = pairs
    more = _cells(classed, open_, found, texts, folder, threshold)
    if more.isEmpty():
        return labels
    return components(more if links is None else links.union(more), f"{folder}/classes{turn}")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, digest, words, class_id, kept): per row its text's digest, whether it has words, the smallest id of its class and whether it is that id's first text in it."""
    folder = shared_folder(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")).alias("digest"), F.coalesce(F.col(text_col).rlike("[^\\x20\\x09-\\x0D]"), F.lit(False)).alias("words"))
    rows = stored(rows, folder, "rows")
    documents = rows.count()
    blocks = write_blocks(docs, folder, id_col, text_col, (), block_bytes)
    buckets = _buckets(blocks.select("block").count())
    counts = stored(document_counts(blocks, buckets), folder, "counts", release=True)
    found = stored(sketches(blocks, counts, documents, threshold), folder, "sketches", release=True)
    labels = linked_texts(found, folder, threshold)
    own = rows.where("words and id is not null").groupBy("digest").agg(F.min("id").alias("least"))
    if labels is None:
        named = own.select(F.col("digest").alias("of"), F.col("least").alias("class"), F.lit(True).alias("first"))
    else:
        heads = own.join(labels, F.col("digest") == F.col("node")).groupBy(F.col("label").alias("part")).agg(F.min(F.struct("least", "digest")).alias("head"))
        whole = labels.join(heads, F.col("label") == F.col("part")).select("node", F.col("head.least").alias("class"), (F.col("node") == F.col("head.digest")).alias("first"))
        named = own.join(whole, F.col("digest") == F.col("node"), "left").select(F.col("digest").alias("of"), F.coalesce("class", "least").alias("class"), F.coalesce("first", F.lit(True)).alias("first"))
    named = stored(named, folder, "named")
    out = rows.join(named, F.col("words") & F.col("id").isNotNull() & (F.col("digest") == F.col("of")), "left")
    kept = F.coalesce(F.col("first") & (F.col("id") == F.col("class")), F.lit(True)).alias("kept")
    out = stored(out.select("id", "digest", "words", F.coalesce("class", "id").alias("class_id"), kept), folder, "classes")
    discard(docs.sparkSession, folder, keep=("classes",))
    return out


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: doc_id, class_id (the smallest id of its class) and kept (the class's one row with that id)."""
    return classes(docs, id_col, text_col, **options).select(F.col("id").alias("doc_id"), "class_id", "kept")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one document of each class, that with the class's smallest id; rows that repeat an id and text stay once."""
    plain, own = renamed(docs)
    found = classes(plain, own[id_col], own[text_col], **options)
    digest = F.md5(F.coalesce(F.col(own[text_col]).cast("string"), F.lit("")).cast("binary"))
    marked = plain.withColumns({"number": F.col(own[id_col]).cast("long"), "digest": digest})
    same = (F.col("number") == F.col("id")) & (F.col("digest") == F.col("of"))
    gone = found.where("not kept").select("id", F.col("digest").alias("of")).distinct()
    left = marked.join(gone, same, "left_anti")
    twice = found.where("words and kept and id is not null").groupBy("id", F.col("digest").alias("of")).agg(F.count("*").alias("n")).where("n > 1").select("id", "of")
    if not twice.isEmpty():
        left = left.join(twice, same, "left_anti").unionByName(left.join(twice, same, "left_semi").dropDuplicates(["number", "digest"]))
    return own.restore(left)
