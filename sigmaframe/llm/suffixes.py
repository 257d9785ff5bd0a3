"""Removal of repeated passages: every byte under a string of WIDTH bytes that also starts in an earlier document.

Equal strings of WIDTH bytes have the same smallest hash among the PIECE-byte strings in them. Texts
are cut into runs of starts with one smallest hash (neighbouring runs overlap by WIDTH - 1 bytes), so
all copies of a string meet in the bucket of its hash. Only hashes that two documents have are
followed up. In a bucket, the runs' text is sorted by a Burrows-Wheeler transform, threshold-bounded
interval expansion finds which starts share WIDTH bytes, and each such group gets its smallest id.

Exchanges carry one sorted array for each block and bucket: a hash or a run counts once in a block
however often it occurs. A hash with very much different text around it is dealt out further by the
hash of each single string, so no bucket grows with the corpus.

Bytes are those of UTF-8; nulls count as empty texts. Texts shorter than WIDTH keep everything. Rows
that repeat an id are not earlier than each other; a null id is later than all others. Matches are
judged on the input, never across documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, LAST, pack, rest_of, rows_of, texts_of, unpack, write_blocks
from .bwt import repeat_groups
from .textkit import U64, Rolling, Texts, mix, renamed, shared_folder, stored, trim

WIDTH, PIECE = 50, 24
#: Starts that are hashed at a time, and bytes of runs that are sorted at a time.
STEP, SORTED_BYTES = 1 << 18, 1 << 18
#: Starts of one run at most; the runs of text that repeats within itself are then equal, and sorted once.
MOST_STARTS = 128
#: Different text around one hash, in units of UNIT bytes, from which on its strings are dealt out singly.
UNIT, HOT_UNITS = 64, 8_000


def runs(texts: Texts, width: int = WIDTH, piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, Rolling]]:
    """Runs of starts with one smallest hash: hash, document, first start, number of starts; and the step's base and hashes."""
    data, offsets = texts.data, texts.offsets
    span = width - piece + 1
    for base in range(0, max(0, len(data) - width + 1), STEP):
        part = data[base : base + STEP + width - 1]
        roll = Rolling(part)
        least = mix(roll.windows(piece))
        done = 1
        while done < span:
            move = min(done, span - done)
            least = np.minimum(least[: len(least) - move], least[move:])
            done += move
        starts = np.arange(base, base + len(least))
        document = texts.owner(starts)
        within = starts + width <= offsets[document + 1]
        change = np.concatenate([[True], (least[1:] != least[:-1]) | (document[1:] != document[:-1])])
        since = np.arange(len(change))
        since -= np.maximum.accumulate(np.where(change, since, 0))
        change |= since % MOST_STARTS == 0
        heads = np.flatnonzero(change & within)
        # a document's starts that have room for a string are its first ones
        stop = np.flatnonzero(np.concatenate([change | ~within, [True]]))
        ends = stop[np.searchsorted(stop, heads, "right")]
        # least hashes are small ones; mixed again, they spread over all buckets
        yield mix(least[heads]), document[heads], starts[heads], ends - heads, base, roll


def _content(roll: Rolling, base: int, first: np.ndarray, count: np.ndarray, width: int) -> np.ndarray:
    return roll.of(first - base, first - base + count + width - 1)


def _buckets(blocks: int) -> int:
    return 1 << max(5, int(np.ceil(np.log2(max(1, blocks) / 4))))


def _keys(texts: Texts, ids: np.ndarray, width: int, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct hashes in order, whether two of its ids have each, and the units of different text around each."""
    key, doc, content, count = [], [], [], []
    for k, d, s, c, base, roll in runs(texts, width, piece):
        key.append(k)
        doc.append(ids[d])
        content.append(_content(roll, base, s, c, width))
        count.append((c + width - 1 + UNIT - 1) // UNIT)
    if not key:
        return np.zeros(0, U64), np.zeros(0, bool), np.zeros(0, np.int64)
    key, doc, content, count = map(np.concatenate, (key, doc, content, count))
    order = np.lexsort((content, key))
    key, doc, content, count = key[order], doc[order], content[order], count[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    heads = np.flatnonzero(new)
    several = np.minimum.reduceat(doc, heads) != np.maximum.reduceat(doc, heads)
    fresh = new | np.concatenate([[True], content[1:] != content[:-1]])
    return key[heads], several, np.add.reduceat(count * fresh, heads)


def _slices(key: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds of each bucket's part of a sorted array of hashes."""
    bits = buckets.bit_length() - 1
    edges = np.arange(1, buckets, dtype=U64) << U64(64 - bits)
    return np.concatenate([[0], np.searchsorted(key, edges), [len(key)]])


def shared_hashes(blocks: DataFrame, buckets: int, width: int, piece: int, hot_units: int = HOT_UNITS) -> DataFrame:
    """(block, answers): for each block and bucket, which hashes two documents have and which of these are hot."""
    bits = buckets.bit_length() - 1

    def send(batches):
        for batch in batches:
            for row in rows_of(batch):
                ids, texts = texts_of(row)
                key, several, units = _keys(texts, ids, width, piece)
                at = _slices(key, buckets)
                # within a bucket, 32 bits tell its hashes apart; two that agree are followed up for nothing
                short = ((key << U64(bits)) >> U64(32)).astype("<u4")
                own = [k for k in range(buckets) if at[k] < at[k + 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.int32()), pa.array([row["block"]] * len(own), pa.int64()), *(pa.array(v, pa.binary()) for v in zip(*((short[at[k] : at[k + 1]].tobytes(), pack(np.packbits(several[at[k] : at[k + 1]])), pack(np.minimum(units[at[k] : at[k + 1]], 65535).astype("<u2"))) for k in own)))]
                    if own else [pa.array([], t) for t in (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())],
                    ["bucket", "block", "hashes", "several", "units"],
                )

    def meet(table):
        rows = table.to_pylist()
        parts = [np.frombuffer(r["hashes"], "<u4") for r in rows]
        hashes = np.concatenate(parts)
        several = np.concatenate([np.unpackbits(unpack(r["several"], np.uint8), count=len(p)) for r, p in zip(rows, parts)])
        units = np.concatenate([unpack(r["units"], "<u2") for r in rows]).astype(np.int64)
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        size = np.diff(np.append(heads, len(ordered)))
        shared = (size > 1) | (np.maximum.reduceat(several[order], heads) > 0)
        hot = shared & (np.add.reduceat(units[order], heads) > hot_units)
        answer = np.zeros((2, len(hashes)), bool)
        answer[0, order], answer[1, order] = np.repeat(shared, size), np.repeat(hot, size)
        at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        bitsets = [[pack(np.packbits(answer[w, at[k] : at[k + 1]])) for k in range(len(rows))] for w in (0, 1)]
        return pa.table([table.column("block").combine_chunks(), table.column("bucket").combine_chunks(), pa.array(bitsets[0], pa.binary()), pa.array(bitsets[1], pa.binary())], ["block", "bucket", "shared", "hot"])

    sent = blocks.mapInArrow(send, "bucket int, block long, hashes binary, several binary, units binary")
    met = sent.groupBy("bucket").applyInArrow(meet, "block long, bucket int, shared binary, hot binary")
    return met.groupBy("block").agg(F.collect_list(F.struct("bucket", "shared", "hot")).alias("answers"))


def _followed(texts: Texts, ids: np.ndarray, answers: list[dict], buckets: int, width: int, piece: int):
    """The distinct strings of a block to be followed up, and all their places.

    Per string: hash that deals it out, first place, starts, smallest and largest id. Per place:
    number of the string, document, first start.
    """
    pieces = list(runs(texts, width, piece))
    key = np.unique(np.concatenate([k for k, *_ in pieces])) if pieces else np.zeros(0, U64)
    at = _slices(key, buckets)
    shared, hot = np.zeros(len(key), bool), np.zeros(len(key), bool)
    for a in answers:
        k = a["bucket"]
        for to, bits in ((shared, a["shared"]), (hot, a["hot"])):
            to[at[k] : at[k + 1]] = np.unpackbits(unpack(bits, np.uint8), count=at[k + 1] - at[k])
    found = []
    for k, d, s, c, base, roll in pieces:
        where = np.searchsorted(key, k)
        for singly, wanted in ((False, shared & ~hot), (True, hot)):
            own = wanted[where]
            if not own.any():
                continue
            route, document, first, count = k[own], d[own], s[own], c[own]
            if singly:
                first = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
                document, count = np.repeat(document, count), np.ones(len(first), np.int64)
                content = _content(roll, base, first, count, width)
                route = mix(content)
            else:
                content = _content(roll, base, first, count, width)
            found.append((route, document, first, count, content))
    del pieces
    if not found:
        return None
    route, document, first, count, content = map(np.concatenate, zip(*found))
    order = np.lexsort((content, route))
    route, document, first, count, content = (x[order] for x in (route, document, first, count, content))
    new = np.concatenate([[True], (route[1:] != route[:-1]) | (content[1:] != content[:-1])])
    heads = np.flatnonzero(new)
    own = ids[document]
    strings = route[heads], first[heads], count[heads], np.minimum.reduceat(own, heads), np.maximum.reduceat(own, heads)
    return strings, (np.cumsum(new) - 1, document, first)


def _gather(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    return data[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def follow(blocks: DataFrame, answers: DataFrame, buckets: int, width: int, piece: int) -> DataFrame:
    """Rows (kind 1) with strings for a bucket, and one row (kind 0) a block with the strings' places."""

    bits = buckets.bit_length() - 1

    def send(batches):
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 6]
        names = ["kind", "block", "bucket", "low", "routes", "counts", "least", "most", "text", "places"]
        for batch in batches:
            for row in rows_of(batch):
                ids, texts = texts_of(row)
                found = _followed(texts, ids, row["answers"] or [], buckets, width, piece)
                if found is None:
                    continue
                (route, first, count, least, most), (string, document, start) = found
                # a place's document follows from its start
                places = np.concatenate([np.diff(string, prepend=0), start]).astype("<i4")
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((0, row["block"], 0, 0, None, None, None, None, None, pack(places, 3)), kinds)], names)
                at = _slices(route, buckets)
                for k in range(buckets):
                    for a in range(at[k], at[k + 1], 200_000):
                        b = min(at[k + 1], a + 200_000)
                        text = pack(_gather(texts.data, first[a:b], count[a:b] + width - 1), 6)
                        # 32 bits of a hash keep its strings together within a bucket
                        short = ((route[a:b] << U64(bits)) >> U64(32)).astype("<u4")
                        out = (1, row["block"], k, int(a), short.tobytes(), pack(count[a:b].astype("<i4")), pack(least[a:b]), pack(most[a:b] - least[a:b]), text, None)
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out, kinds)], names)
                del ids, texts, found, route, first, count, least, most, string, document, start, places
                trim()

    joined = blocks.select("block", "ids", "offsets", "data").join(answers, "block")
    return joined.mapInArrow(send, "kind int, block long, bucket int, low int, routes binary, counts binary, least binary, most binary, text binary, places binary")


def _earliest(data: np.ndarray, place: np.ndarray, size: np.ndarray, least: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start with room in each of the strings at these places: the smallest id that has its `width` bytes.

    Also the number of starts of each string. Equal strings are sorted once.
    """
    text = _gather(data, place, size)
    end = np.cumsum(size)
    _, first, same = np.unique(Rolling(text).of(end - size, end), return_index=True, return_inverse=True)
    ids = np.full(len(first), LAST)
    np.minimum.at(ids, same, least)
    own = size[first]
    text = _gather(data, place[first], own)
    group = repeat_groups(text, width)
    begin, room = np.cumsum(own) - own, own - width + 1
    at = np.repeat(begin - (np.cumsum(room) - room), room) + np.arange(int(room.sum()))
    group = group[at]
    earliest = np.full(int(group.max()) + 1, LAST)
    np.minimum.at(earliest, group, np.repeat(ids, room))
    by_start = earliest[group]
    return _gather(by_start, (np.cumsum(room) - room)[same], room[same]), room[same]


def repeats(strings: DataFrame, width: int, sorted_bytes: int = SORTED_BYTES) -> DataFrame:
    """(block, found): per block, runs (string, first, end, id) of starts whose bytes an earlier id has."""

    def meet(table):
        rows = table.select(["block", "low", "routes", "counts", "least", "most", "text"]).to_pylist()
        routes = [np.frombuffer(r["routes"], "<u4") for r in rows]
        route = np.concatenate(routes)
        size = np.concatenate([unpack(r["counts"], "<i4") for r in rows]).astype(np.int64) + width - 1
        owner = np.repeat(np.arange(len(rows)), [len(x) for x in routes])
        number = np.concatenate([np.arange(len(x)) + r["low"] for x, r in zip(routes, rows)])
        least, most = (np.concatenate([unpack(r[c], "<i8") for r in rows]) for c in ("least", "most"))
        most = most + least
        data = np.concatenate([unpack(r["text"], np.uint8) for r in rows])
        place = np.cumsum(size) - size
        order = np.argsort(route, kind="stable")
        total = np.cumsum(size[order])
        last = np.append(route[order][1:] != route[order][:-1], True)
        found: list[tuple[np.ndarray, ...]] = []
        at = 0
        while at < len(order):
            # whole groups of one hash, up to sorted_bytes (or one group)
            upto = np.searchsorted(total, (total[at - 1] if at else 0) + sorted_bytes, "right")
            ends = np.flatnonzero(last[at:upto])
            end = at + ends[-1] + 1 if len(ends) else at + int(np.argmax(last[at:])) + 1
            own = order[at:end]
            earliest, room = _earliest(data, place[own], size[own], least[own], width)
            string = np.repeat(np.arange(len(own)), room)
            start = np.arange(len(string)) - np.repeat(np.cumsum(room) - room, room)
            hit = np.flatnonzero(earliest < most[own][string])
            if len(hit):
                new = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (earliest[hit[1:]] != earliest[hit[:-1]]) | (string[hit[1:]] != string[hit[:-1]])])
                heads = np.flatnonzero(new)
                tails = np.append(heads[1:], len(hit)) - 1
                which = own[string[hit[heads]]]
                found.append((owner[which], number[which], start[hit[heads]], start[hit[tails]] + 1, earliest[hit[heads]]))
            at = end
        blocks, blobs = [], []
        if found:
            columns = [np.concatenate(x) for x in zip(*found)]
            by = np.argsort(columns[0], kind="stable")
            edges = np.searchsorted(columns[0][by], np.arange(len(rows) + 1))
            for k, r in enumerate(rows):
                some = by[edges[k] : edges[k + 1]]
                if len(some):
                    blocks.append(r["block"])
                    blobs.append(pack(np.stack([c[some] for c in columns[1:]]).astype("<i8")))
        del rows, routes, route, size, owner, number, least, most, data, place, order, total, last, found
        trim()
        return pa.table([pa.array(blocks, pa.int64()), pa.array(blobs, pa.binary())], ["block", "found"])

    met = strings.where("kind = 1").select("bucket", "block", "low", "routes", "counts", "least", "most", "text").groupBy("bucket").applyInArrow(meet, "block long, found binary")
    return met.groupBy("block").agg(F.collect_list("found").alias("found"))


def _covered(texts: Texts, ids: np.ndarray, places: bytes | None, found: list[bytes] | None, width: int) -> np.ndarray:
    """Which bytes of a block are to be removed."""
    if places is None or not found:
        return np.zeros(len(texts.data), bool)
    string, start = unpack(places, "<i4").reshape(2, -1).astype(np.int64)
    string, document = np.cumsum(string), texts.owner(start)
    at = np.searchsorted(string, np.arange(string[-1] + 2))
    which, low, high, earliest = np.concatenate([unpack(blob, "<i8").reshape(4, -1) for blob in found], 1)
    change = np.zeros(len(texts.data) + 1, np.int32)
    for part in range(0, len(which), 200_000):
        some = slice(part, part + 200_000)
        n = at[which[some] + 1] - at[which[some]]
        k = np.repeat(np.arange(len(n)), n)
        place = np.repeat(at[which[some]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        later = earliest[some][k] < ids[document[place]]
        k, place = k[later], place[later]
        for edge, step in ((start[place] + low[some][k], 1), (start[place] + high[some][k] + width - 1, -1)):
            where, times = np.unique(edge, return_counts=True)
            change[where] += step * times.astype(np.int32)
    return np.cumsum(change, dtype=np.int32)[:-1] > 0


def _judged(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...], width: int, piece: int, block_bytes: int, hot_units: int, sorted_bytes: int) -> DataFrame:
    folder = shared_folder(docs.sparkSession)
    blocks = write_blocks(docs, folder, id_col, text_col, keep, block_bytes)
    buckets = _buckets(blocks.select("block").count())
    answers = shared_hashes(blocks, buckets, width, piece, hot_units)
    strings = stored(follow(blocks, answers, buckets, width, piece), folder, "strings", release=True)
    places = strings.where("kind = 0").select("block", "places")
    return blocks.join(places, "block", "left").join(repeats(strings, width, sorted_bytes), "block", "left")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, piece: int = PIECE, block_bytes: int = BLOCK_BYTES, hot_units: int = HOT_UNITS, sorted_bytes: int = SORTED_BYTES) -> DataFrame:
    """Per document: bytes, removed bytes, maximal removed runs and the digest of what remains."""

    def run(batches):
        for batch in batches:
            for row in rows_of(batch):
                ids, texts = texts_of(row)
                gone = _covered(texts, ids, row["places"], row["found"], width)
                begins = gone & np.concatenate([[True], ~gone[:-1]]) if len(gone) else gone
                edge = texts.offsets[:-1][np.diff(texts.offsets) > 0]
                begins[edge] |= gone[edge]
                sums, spans = (np.concatenate([[0], np.cumsum(x)])[texts.offsets] for x in (gone, begins))
                digests = [hashlib.sha256(texts.data[a:b][~gone[a:b]].tobytes()).hexdigest() for a, b in zip(texts.offsets[:-1], texts.offsets[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == LAST), pa.array(np.diff(texts.offsets)), pa.array(np.diff(sums)), pa.array(np.diff(spans)), pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
                del texts, gone, begins, sums, spans
                trim()

    return _judged(docs, id_col, text_col, (), width, piece, block_bytes, hot_units, sorted_bytes).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, piece: int = PIECE, block_bytes: int = BLOCK_BYTES, hot_units: int = HOT_UNITS, sorted_bytes: int = SORTED_BYTES) -> DataFrame:
    """docs with repeated bytes cut out of their texts; a character that is cut in part goes as a whole."""
    plain, own = renamed(docs)
    columns, text = list(plain.columns), own[text_col]
    others = tuple(c for c in columns if c != text)

    def run(batches):
        for batch in batches:
            for row in rows_of(batch):
                ids, texts = texts_of(row)
                gone = _covered(texts, ids, row["places"], row["found"], width)
                left = [texts.data[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore") for a, b in zip(texts.offsets[:-1], texts.offsets[1:])]
                rest = rest_of(row["rest"])
                by_name = dict(zip(others, rest.columns)) | {text: pa.array(left, pa.string())}
                yield pa.RecordBatch.from_arrays([by_name[c] for c in columns], columns)
                del ids, texts, gone, left, rest, by_name
                trim()

    judged = _judged(plain, own[id_col], text, others, width, piece, block_bytes, hot_units, sorted_bytes)
    return own.restore(judged.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)))
