"""Token ids in Simple-8b files (operator 5).

A shard is a binary image of whole documents: a header, the documents' ids and
lengths, and their token ids as 64-bit words whose top four bits select how many
ids of how many bits the other sixty hold. Ids of over sixty bits go to an escape
table, named by its index. Ids are packed in blocks of ``BLOCK``; the image holds each block's first
word, so encoder and decoder treat all blocks at once, in numpy, and a reader can
begin at any block. Images are the binary values of Parquet rows: any file
system Spark writes can hold them, and its commit protocol makes their writing
atomic when executors are lost or tasks run twice.

Order: rows are range-partitioned by (doc_id, hash of the text), sorted and
written; a document's ``start`` is its partition's start (the driver sums one
number per partition) plus the ids that the same task wrote before it. One
shuffle of the texts; everything else is sequential within a partition.

Tokens: a text's pieces between white space are encoded on their own, as the
normaliser and splitter of the vocabulary never join pieces over white space. All pieces
of a chunk of documents are found and hashed at once by numpy and compared byte by
byte with the first of their hash; each distinct one is looked up, by 128 bits of
hash, among those met before, whose number is bounded, and a text's ids are gathered from those of its pieces. A piece of
Latin letters followed by ASCII marks is cut between the two and goes to the library's
BPE model directly, any other through its whole encoder. The results equal those of the whole text (tested). A vocabulary
file of another normaliser, splitter or model is not cut into pieces: the library encodes whole texts.

Defined cases: a null or empty text is the end id alone; null ids come first;
rows that repeat an id follow each other by the hash of their text, equal rows in
any order; a text of any length is one document in one shard, encoded in parts
of ``AT_ONCE`` bytes; ids may be integers or text (in its order); an empty table
gives no shard and an empty result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CHUNK, SPACE, Prefix, chunks, mix, read_table, stored, words_of

END_ID = 2
BLOCK = 1024
SHARD_IDS = 1 << 18
#: Pieces whose ids a worker keeps, and the bytes of the longest.
CACHE = 500_000
LONGEST = 64
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Simple-8b: ids per word by selector, and bits of each.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
ONE, ESCAPE = 15, 1  # a single id; an escape is selector 1 with its low bit set (its 120 zeros leave the payload free)
HEADER = struct.Struct("<4sIQQQQQ")
MAGIC = b"S8B2"


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block, escape table) of unsigned ids."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    blocks, pad = -(-n // BLOCK), int(COUNTS[0])
    grid = np.zeros((blocks, BLOCK + pad), np.uint64)
    full = n // BLOCK
    grid[:full, :BLOCK] = ids[: full * BLOCK].reshape(full, BLOCK)
    if full < blocks:
        grid[full, : n - full * BLOCK] = ids[full * BLOCK :]
    flat = grid.ravel()
    escaped = np.flatnonzero(flat >> np.uint64(60))
    table = flat[escaped].copy()
    # Widths by comparison with each selector's limit: the narrowest class that holds the id.
    limits = (np.uint64(1) << WIDTHS[1:].astype(np.uint64)) - np.uint64(1)
    # Class k: width WIDTHS[k + 1]. Ids of 16 bits, by far most, are looked up.
    small = np.searchsorted(limits, np.arange(1 << 16, dtype=np.uint64)).astype(np.int8)
    klass = small[flat] if ids.max() < 1 << 16 else np.searchsorted(limits, flat).astype(np.int8)
    pick = np.full(len(flat), ONE, np.int8)
    for s in range(14, -1, -1):
        count, within = int(COUNTS[s]), klass <= max(s - 1, 0)
        at = np.flatnonzero(within)
        if len(at) >= count:
            fits = at[count - 1 :] - at[: len(at) - count + 1] == count - 1
            pick[at[: len(at) - count + 1][fits]] = s
    if len(escaped):
        pick[escaped] = ONE  # replaced below
    wide = BLOCK + pad
    length = np.full(blocks, BLOCK)
    length[-1] = n - (blocks - 1) * BLOCK
    where, lane = np.zeros(blocks, np.int64), np.arange(blocks)
    heads: list[np.ndarray] = []
    lanes: list[np.ndarray] = []
    while len(lane):
        head = lane * wide + where[lane]
        heads.append(head)
        lanes.append(lane)
        where[lane] += COUNTS[pick[head]]
        lane = lane[where[lane] < length[lane]]
    head, lane = np.concatenate(heads), np.concatenate(lanes)
    order = np.argsort(head, kind="stable")
    head, lane = head[order], lane[order]
    chosen = pick[head].astype(np.int64)
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        if WIDTHS[s]:
            mine = np.flatnonzero(chosen == s)
            for k in range(int(COUNTS[s])):
                words[mine] |= (flat[head[mine] + k] & np.uint64(2**60 - 1)) << np.uint64(k * int(WIDTHS[s]))
    if len(escaped):
        at = np.searchsorted(head, escaped)
        words[at] = (np.uint64(ESCAPE) << np.uint64(60)) | (np.arange(len(escaped), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
    first = np.searchsorted(lane, np.arange(blocks)).astype(np.uint32)
    return words, first, table


def decode(words: np.ndarray, first: np.ndarray, table: np.ndarray, n: int) -> np.ndarray:
    """The ids of all blocks."""
    if not n:
        return np.zeros(0, np.uint64)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    escape = (chosen == ESCAPE) & ((words & np.uint64(1)) == 1)
    count = np.where(escape, 1, COUNTS[chosen])
    before = np.concatenate(([0], np.cumsum(count)))[:-1]
    block = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(words)).astype(np.int64)))
    start = before - before[first][block] + block * BLOCK  # ids that a block's last word has too many are cut off below
    stop = np.minimum((block + 1) * BLOCK, n)
    out = np.zeros(n, np.uint64)
    for s in np.unique(chosen):
        width = int(WIDTHS[s])
        if width:
            mine = np.flatnonzero(chosen == s)
            for k in range(int(COUNTS[s])):
                to = start[mine] + k
                ok = to < stop[mine]
                out[to[ok]] = (words[mine[ok]] >> np.uint64(k * width)) & np.uint64((1 << width) - 1)
    if escape.any():
        out[start[escape]] = table[(words[escape] & np.uint64(2**60 - 1)) >> np.uint64(1)]
    return out


def pack(docs: list[tuple[int | str | None, np.ndarray]]) -> bytes:
    """The image of a shard: (doc_id, unsigned ids) in order; doc_ids are all integers or all text."""
    ids = np.concatenate([x for _, x in docs]).astype(np.uint64) if docs else np.zeros(0, np.uint64)
    words, first, table = encode(ids)
    known = np.array([d is not None for d, _ in docs], np.uint8)
    if any(isinstance(d, str) for d, _ in docs):
        said = [(d or "").encode() for d, _ in docs]
        sizes = np.array([len(x) for x in said], "<i8")
        letters = b"".join(said)
    else:
        sizes, letters = np.array([d or 0 for d, _ in docs], "<i8"), None
    lengths = np.array([len(x) for _, x in docs], "<u8")
    head = HEADER.pack(MAGIC, BLOCK, len(docs), len(ids), len(words), len(table), 0 if letters is None else len(letters) + 1)
    return b"".join((head, sizes.tobytes(), lengths.tobytes(), words.astype("<u8").tobytes(), table.astype("<u8").tobytes(), first.astype("<u4").tobytes(), known.tobytes(), letters or b""))


def unpack(image: bytes) -> tuple[list[int | str | None], np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids) of a shard's image."""
    magic, block, n_docs, n, n_words, n_table, n_letters = HEADER.unpack_from(image)
    if magic != MAGIC or block != BLOCK:
        raise ValueError("not a shard of this format")
    at = HEADER.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(image, kind, count, at)
        at += out.nbytes
        return out

    names, lengths, words, table, first, known = take("<i8", n_docs), take("<u8", n_docs), take("<u8", n_words), take("<u8", n_table), take("<u4", -(-n // BLOCK)), take("u1", n_docs)
    if n_letters:
        ends = at + np.cumsum(names)
        said = [image[e - k : e].decode() for e, k in zip(ends.tolist(), names.tolist(), strict=True)]
    else:
        said = names.tolist()
    return [d if k else None for d, k in zip(said, known, strict=True)], lengths.astype(np.int64), decode(words, first, table, n)


# --- tokens ------------------------------------------------------------------

#: Latin-1 letters, then ASCII marks that neither begin a contraction nor a special token.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:;=?@\[-`{}~]*)")
#: Python splits at these, the vocabulary's splitter does not.
_ODD = re.compile("[\x1c-\x1f]")


#: Of each byte: 0 white space, 1 an ASCII letter, 2 a mark of _PLAIN, 3 anything else.
_KIND = np.array([0 if SPACE[b] else 3 if b > 127 or not (m := _PLAIN.fullmatch(chr(b))) else 1 if m[1] else 2 for b in range(256)], np.uint8)


def _byte_letters() -> list[str]:
    """Byte-level alphabets show printable Latin-1 as itself and the other bytes, in order, from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


#: The kind of vocabulary whose texts may be cut at white space.
_CUTTABLE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_CUTTABLE_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "end_of_word_suffix": "</w>", "byte_fallback": False}


class Known:
    """Ids of pieces by 128 bits of hash, as sorted arrays: some 40 bytes an entry.

    At MOST entries those that were not asked for since the last time go.
    """

    def __init__(self, most: int):
        self.most = most
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.starts, self.sizes, self.used = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
        self.flat = np.zeros(0, "<u4")

    def find(self, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each is known, its place)."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = (self.keys[at] == keys) & (self.checks[at] == checks)
        self.used[at[hit]] = True
        return hit, at

    def add(self, keys: np.ndarray, checks: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        """New keys, in order."""
        if len(self.keys) + len(keys) > self.most:
            self._drop()
        place = np.searchsorted(self.keys, keys)
        starts = len(self.flat) + np.cumsum(sizes) - sizes
        self.flat = np.concatenate((self.flat, flat))
        for name, new in (("keys", keys), ("checks", checks), ("starts", starts), ("sizes", sizes), ("used", np.ones(len(keys), bool))):
            setattr(self, name, np.insert(getattr(self, name), place, new))

    def _drop(self) -> None:
        keep = np.flatnonzero(self.used)
        if len(keep) > self.most // 2:
            keep = keep[:0]
        self.flat = gathered(self.flat, self.starts[keep], self.sizes[keep])
        self.keys, self.checks, self.sizes = self.keys[keep], self.checks[keep], self.sizes[keep]
        self.starts, self.used = np.cumsum(self.sizes, dtype=np.int64) - self.sizes, np.zeros(len(keep), bool)


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of flat of these starts and sizes, one after the other."""
    sizes = sizes.astype(np.int64)
    return flat[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


class Pieces:
    """A vocabulary file's ids of texts, and the pieces met so far."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.cuttable = type(self.model).__name__ == _CUTTABLE_MODEL["type"] and all(
            [json.loads(getattr(self.whole, k).__getstate__() if getattr(self.whole, k) is not None else "null") == v for k, v in _CUTTABLE.items()]
            + [getattr(self.model, k) == v for k, v in _CUTTABLE_MODEL.items() if k != "type"]
        )
        self.letters = _byte_letters()
        self.known = Known(CACHE)

    def of_model(self, word: str) -> list[int]:
        shown = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
        return [t.id for t in self.model.tokenize(shown)]

    def of_whole(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def of_text(self, text: str) -> list[int]:
        if _ODD.search(text):
            return self.of_whole(text)
        out = []
        for part in text.split():
            m = _PLAIN.fullmatch(part)
            if m is None:
                out += self.of_whole(part)
            else:
                for x in (m[1].lower(), m[2]):
                    out += self.of_model(x) if x else ()
        return out

    def made(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each) of pieces that are not known yet (lower-case where they are plain)."""
        tokenize, out, sizes = self.model.tokenize, array("I"), []
        for piece in pieces:
            ids = [t.id for t in tokenize(piece.decode())] if piece.isalpha() and piece.islower() else self.of_text(piece.decode())
            out.extend(ids)
            sizes.append(len(ids))
        return np.array(out, "<u4"), np.array(sizes, np.int32)

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) of a chunk of texts."""
        n = len(offsets) - 1
        if not self.cuttable:
            raw = data.tobytes()
            made = [array("I", self.of_whole(raw[a:b].decode())).tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            return np.frombuffer(b"".join(made), "<u4"), np.array([len(x) // 4 for x in made], np.int64)
        start, end, doc = words_of(data, offsets)
        if not len(start):
            return np.zeros(0, "<u4"), np.zeros(n, np.int64)
        start, end, doc, data = simple_parts(data, start, end, doc)
        raw = data.tobytes()
        _, first, which = np.unique(Prefix(data).of(start, end), return_index=True, return_inverse=True)
        # Pieces that only share a hash with the first of theirs count on their own.
        other = np.flatnonzero(~equal_pieces(raw, start, end, start[first][which], end[first][which]))
        if len(other):
            which[other] = len(first) + np.arange(len(other))
            first = np.concatenate((first, other))
        keys, checks, short = Prefix(data).of(start[first], end[first]), checks_of(raw, start[first], end[first]), end[first] - start[first] <= LONGEST
        hit, place = self.known.find(keys, checks)
        hit &= short
        sizes, at = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        sizes[hit], at[hit] = self.known.sizes[place[hit]], self.known.starts[place[hit]]
        new = np.flatnonzero(~hit)
        new = new[np.argsort(keys[new], kind="stable")]
        fresh, fresh_sizes = self.made([raw[a:b] for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
        flat = np.concatenate((self.known.flat, fresh))
        sizes[new], at[new] = fresh_sizes, len(self.known.flat) + np.cumsum(fresh_sizes, dtype=np.int64) - fresh_sizes
        count = sizes[which]
        ids = gathered(flat, at[which], count)
        keep = short[new] & np.concatenate((keys[new][1:] != keys[new][:-1], [True]))[: len(new)]
        self.known.add(keys[new][keep], checks[new][keep], gathered(fresh, (np.cumsum(fresh_sizes, dtype=np.int64) - fresh_sizes)[keep], fresh_sizes[keep]), fresh_sizes[keep])
        return ids, np.bincount(doc, weights=count, minlength=n).astype(np.int64)


def ends_of(raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last eight bytes of each piece (of a shorter one all, twice), as numbers."""
    wide = np.ndarray((len(raw) + 1,), "<u8", raw + bytes(8), 0, (1,))  # eight bytes from each position on
    size = end - start
    mask = _LOW_BYTES[np.minimum(size, 8)]
    return wide[start] & mask, wide[start + np.maximum(size - 8, 0)] & mask


def checks_of(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A second hash of each piece, of its ends and size."""
    head, tail = ends_of(raw, start, end)
    return mix(mix(head) * np.uint64(0xA24BAED4963EE407) + mix(tail + (end - start).astype(np.uint64)))


def equal_pieces(raw: bytes, start: np.ndarray, end: np.ndarray, other: np.ndarray, other_end: np.ndarray) -> np.ndarray:
    """Whether the bytes [start, end) are those of [other, other_end): by their first and last eight, and one by one where there are more."""
    size = end - start
    (head, tail), (other_head, other_tail) = ends_of(raw, start, end), ends_of(raw, other, other_end)
    same = (size == other_end - other) & (head == other_head) & (tail == other_tail)
    for k in np.flatnonzero(same & (size > 16)).tolist():
        same[k] = raw[start[k] : end[k]] == raw[other[k] : other_end[k]]
    return same


def simple_parts(data: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, documents, bytes) of pieces, where those of Latin letters and then plain marks are cut between the two and their A-Z lower-cased."""
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] & 0xC0 == 0x80) & (data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = 1
    turn = np.zeros(len(data), bool)
    turn[1:] = (kind[1:] == 1) & (kind[:-1] == 2)
    turn[start] = False
    wrong = np.concatenate(([0], np.cumsum((kind == 3) | turn)))
    odd = wrong[end] != wrong[start]
    cut = np.flatnonzero((kind[1:] == 2) & (kind[:-1] == 1)) + 1
    of = np.searchsorted(start, cut, side="right") - 1
    keep = ~odd[of] & (cut > start[of])
    cut, of = cut[keep], of[keep]
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    if odd.any():
        edge = np.zeros(len(data) + 1, np.int8)
        np.add.at(edge, start[odd], 1)
        np.add.at(edge, end[odd], -1)
        low = np.where(np.cumsum(edge[:-1]) > 0, data, low)
    order = np.argsort(np.concatenate((start, cut)), kind="stable")
    starts, docs = np.concatenate((start, cut))[order], np.concatenate((doc, doc[of]))[order]
    return starts, np.sort(np.concatenate((end, cut))), docs, low


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


#: Bytes of texts at a time: of more, fewer distinct pieces are left to look up.
AT_ONCE = 2 * CHUNK


def parts(data: np.ndarray, size: int = AT_ONCE) -> Iterator[np.ndarray]:
    """A text in parts of about `size` bytes, cut at white space only."""
    at = 0
    while at < len(data):
        to = at + size
        if to < len(data):
            back = np.flatnonzero(SPACE[data[at:to]])
            on = np.flatnonzero(SPACE[data[to:]])[:1] if not len(back) else back
            to = at + int(back[-1]) + 1 if len(back) else to + int(on[0]) + 1 if len(on) else len(data)
        yield data[at:to]
        at = to


def token_ids(texts: pa.Array, vocabulary: Pieces, size: int = AT_ONCE) -> Iterator[np.ndarray]:
    """The ids of each text in turn."""
    for _, _, data, offsets in chunks(texts, size):
        if len(offsets) == 2 and len(data) > size and vocabulary.cuttable:
            yield np.concatenate([vocabulary.ids(x, np.array([0, len(x)]))[0] for x in parts(data, size)])
            continue
        ids, counts = vocabulary.ids(data, offsets)
        yield from np.split(ids, np.cumsum(counts)[:-1])


# --- shards ------------------------------------------------------------------


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = END_ID, partitions: int | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes docs in ascending doc_id order to the shared folder; (part, before, n_ids, image) of every shard.

    tokenizer: the path of a vocabulary file of the tokenizers library, there on every machine.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, held, size = TaskContext.get().partitionId(), 0, [], 0
        end = np.array([end_id], "<u4")
        vocabulary = pieces(tokenizer)

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([before]), pa.array([size]), pa.array([pack(held)], pa.binary())], names=["part", "before", "n_ids", "image"])

        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), token_ids(batch.column(1), vocabulary), strict=True):
                held.append((name, np.concatenate((ids, end))))
                size += len(ids) + 1
                if size >= shard_ids:
                    yield shard()
                    before, held, size = before + size, [], 0
        if held:
            yield shard()

    order = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    ordered = order.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select(F.col("doc_id").cast(id_type(docs)), "text")
    return stored(ordered.mapInArrow(run, "part int, before long, n_ids long, image binary"))


def id_type(docs: DataFrame) -> str:
    """The type of doc_ids in shards: long, or string where docs' are no integers."""
    return "long" if isinstance(docs.schema["doc_id"].dataType, T.IntegralType) else "string"


def read_shards(shards: DataFrame, kind: str = "long") -> DataFrame:
    """doc_id (long or string, as written), start, n_tokens, ids_crc32, read back from the images."""
    spark = shards.sparkSession
    totals = sorted((r.part, r.n) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # one row per partition
    rows, start = [], 0
    for part, n in totals:
        rows.append((part, start))
        start += n
    starts = F.broadcast(spark.createDataFrame(rows, "part int, part_start long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                names, lengths, ids = unpack(batch.column(1)[k].as_py())
                at = np.concatenate(([0], np.cumsum(lengths)))
                raw = ids.astype("<u4").tobytes()
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64() if kind == "long" else pa.string()), pa.array(at[:-1] + batch.column(0)[k].as_py()), pa.array(lengths), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = shards.join(starts, "part").select((F.col("part_start") + F.col("before")).alias("start"), "image")
    return placed.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenized(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    return read_shards(write_shards(docs, tokenizer or vocabulary_path()), id_type(docs))


def op5_simple8b_tokens(spark, sf_dir: str) -> DataFrame:
    return tokenized(read_table(spark, sf_dir, "documents"))
